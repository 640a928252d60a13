"""The training-data operators against plain Python, on small tables made here."""

import hashlib
import random
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from covote.llm import ann, bpe, html, lmscore, minhash, packing, passages, pii, rules, toxicity
from covote.llm.common import WordCodes, components, mix, seeds, shingles
from covote.llm.minhash import coded

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, rank string, key string"


def prose(seed, n, words=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(words)}" + ("." if r.random() < 0.1 else "") for _ in range(n))


def docs(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", 0, "x", "y", "z") for i, t in zip(ids, texts, strict=True)], DOCS)


AWKWARD = [None, "", "   \n", "one", prose(1, 60), prose(1, 60), prose(2, 3000), "é" * 5000, "a b " * 900, "Mail x@y.org 10.0.0.1"]
OPERATORS = {
    "toxicity": lambda d: toxicity.predict(d, toxicity.Model({"w1": 9.0}, -6.0)),
    "toxicity_clean": lambda d: toxicity.clean(d, toxicity.Model({"w1": 9.0}, -6.0)),
    "bpe": lambda d: bpe.digests(d, RANKS, public_tokenizers.PATTERN),
    "lmscore": lambda d: lmscore.scored(d, F.col("doc_id") % 2 == 0),
    "rules": rules.judged,
    "passages": passages.without_repeats,
    "minhash": minhash.near_duplicates,
    "pii": pii.replace_pii,
    "packing": lambda d: packing.packed(d, JSON, public_tokenizers.PATTERN),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows(spark, name):
    ids = [*range(8), None, 3]  # a null id and a repeated one
    rows = OPERATORS[name](docs(spark, AWKWARD, ids)).collect()
    if name not in ("packing", "toxicity_clean"):
        assert Counter(r["doc_id"] for r in rows) == Counter(ids)
    assert OPERATORS[name](docs(spark, AWKWARD, ids).limit(0)).collect() == []


def test_toxicity_learns_sentences_from_documents(spark):
    texts, labels = [], []
    for k in range(300):
        parts = [prose(10 * k + j, 12) for j in range(6)]
        if k % 3 == 0:
            parts[k % 6] += " you vile fool"
        texts.append(". ".join(parts))
        labels.append((k, int(k % 3 == 0)))
    data = docs(spark, texts)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(data, marks.where("doc_id < 240"))
    for r in toxicity.predict(data, model).where("doc_id >= 240").collect():
        assert r.predicted == int(r.doc_id % 3 == 0)
        assert 0 <= r.score <= 1
        for s in r.sentences:
            assert "fool" in texts[r.doc_id][s.start : s.start + s.length]
    assert toxicity.fit(data.limit(0), marks).weights == {}


def test_bpe_equals_tiktoken():
    import tiktoken

    codec = bpe.Codec(bpe.model_proto(bpe.read_ranks(RANKS)), public_tokenizers.PATTERN)
    own = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={}
    )
    r, letters = random.Random(3), ["'s", "a", "é", " ", "  ", "\n", "1", "٣", "!", "中", "🙂", "<|endoftext|>", "\x00", "the", "\x85"]
    for _ in range(1500):
        text = "".join(r.choice(letters) for _ in range(r.randrange(15)))
        assert codec.encode(text) == own.encode_ordinary(text)
        assert codec.decoded(codec.encode(text)) == text.encode()


def test_packing_is_the_tokenizers_ids(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(JSON)
    special = ["<|endoftext|> 's  x", "a <|endoftext|> b", "<|endoftext|><|endoftext|>\n<|endoftext", " <|endoftext|>é"]
    texts = [*AWKWARD, *special, *(prose(k, 40 * k) for k in range(30))]
    rows = packing.packed(docs(spark, texts).coalesce(1), JSON, public_tokenizers.PATTERN).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for k, t in enumerate(texts):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(by_doc[k], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            at += r.length
            assert r.ids_crc32 == zlib.crc32(ids[r.start : at].tobytes())
        assert at == len(ids)
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        assert [p.offset for p in pieces] == list(np.cumsum([0, *(p.length for p in pieces)])[:-1])
        assert sum(p.length for p in pieces) <= 1024
    assert len(by_sequence) == -(-sum(r.length for r in rows) // 1024)


def test_language_model_counts(spark):
    texts = [prose(k % 7, 50) + f" Only{k}" for k in range(40)] + [None, "UPPER upper", "\x1cx\x85y"]
    learn = [k for k in range(len(texts)) if k % 3]
    words = [(t or "").encode().lower().split() + [b""] for t in texts]
    c = Counter(w for k in learn for w in words[k])
    n, v = sum(c.values()), len(c)
    for r in lmscore.scored(docs(spark, texts), F.col("doc_id") % 3 != 0).collect():
        mine = words[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(mine), sum(w in c for w in mine), n)
        assert r.base_score == pytest.approx(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in mine))
        assert r.score < 0


def test_bit_predictions_are_a_distribution():
    words = [w.encode() for w in prose(5, 3000).split()]
    mixer = lmscore.Mixer(lmscore.counts(sorted(set(words))))
    mixer.learn(sorted(set(words)))
    one = sum(10 ** mixer.log10([bytes([b])])[0] for b in range(1, 256) if b != 32)
    assert one + 10 ** mixer.log10([b""])[0] < 1
    assert mixer.log10([b"w12"])[0] > mixer.log10([b"zqk"])[0] + 2


def test_bit_predictions_learn_from_every_word(spark):
    """Weights and map are the mean of what each partition learns from all its words."""
    words = spark.range(0, 3000, 1, 3).selectExpr("CAST(concat('w', id * 7919) AS BINARY) AS w")
    got, parts = lmscore.trained(words), words.rdd.glom().collect()
    each = []
    for some in parts:
        each.append(lmscore.Mixer(got.table))
        each[-1].learn([bytes(r.w) for r in some], passes=1)
    for name in ("weights", "map"):
        mean = np.average([getattr(m, name) for m in each], axis=0, weights=[len(p) for p in parts])
        assert np.allclose(getattr(got, name), mean, atol=1e-5)
        assert not np.allclose(mean, getattr(lmscore.Mixer(got.table), name), atol=1e-3)


def test_bit_predictions_learn_in_two_passes(spark, monkeypatch):
    """The second pass goes on with the mean of the first, at its own rate, and the scores have both."""
    words = spark.range(0, 3000, 1, 3).selectExpr("CAST(concat('w', id * 7919) AS BINARY) AS w")
    got, parts = lmscore.trained(words, 2), words.rdd.glom().collect()
    mean = lmscore.Mixer(got.table)
    for done in range(2):
        each = []
        for some in parts:
            each.append(lmscore.Mixer(got.table))
            each[-1].weights, each[-1].map = mean.weights.copy(), mean.map.copy()
            each[-1].learn([bytes(r.w) for r in some], passes=1, first=done)
        sizes = [len(p) for p in parts]
        mean.weights, mean.map = (
            np.average([getattr(m, x) for m in each], axis=0, weights=sizes).astype(np.float32) for x in ("weights", "map")
        )
    assert np.allclose(got.weights, mean.weights, atol=1e-5) and np.allclose(got.map, mean.map, atol=1e-5)
    made, asked = lmscore.trained, []
    monkeypatch.setattr(lmscore, "trained", lambda w, passes=1: asked.append(passes) or made(w, passes))
    assert lmscore.scored(docs(spark, ["one two three", "two zqk"]), F.col("doc_id") == 0).count() == 2
    assert asked == [2]


def test_open_stretches_meet_the_passages_of_their_text_once(spark):
    spans, width, need = [(0, 60), (200, 55)], 46, 40
    found = spark.createDataFrame([(1, 5, *x) for x in spans] + [(2, 6, 0, 90)], "doc_id long, of_text long, start int, n_words int")
    (one,) = passages.passages_of(found).where("doc_id = 1").collect()
    assert sorted(map(tuple, passages.span_rows(np.array(one.done)).tolist())) == spans
    whole = (1 << width) - 1
    rows = [(k, 1, 5, c, whole, 20) for k, c in enumerate((10, 55, 80, 190, 230, 500))] + [(9, 3, 7, 10, whole, 20), (10, 2, 6, 45, whole, 20)]
    still = spark.createDataFrame(rows, "k long, doc_id long, of_text long, c int, mask long, m long")
    expected = {r[0]: passages.uncovered(r[3], {1: spans, 2: [(0, 90)], 3: []}[r[1]], width, need) for r in rows}
    got = {r.k: r.mask for r in passages.closed(still, found, 50, 0.8).collect()}
    assert got == {k: m for k, m in expected.items() if m} and 0 < len(got) < len(rows)


def test_rules_counts_and_outliers(spark):
    texts = [prose(k, 120) for k in range(200)] + [prose(900, 100).replace(" ", "### "), "x y z w\nx y z w\n" + prose(901, 70), AWKWARD[8], None]
    rows = {r.doc_id: r for r in rules.judged(docs(spark, texts)).collect()}
    for k, t in enumerate(texts):
        w = (t or "").split()
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        twice = Counter(grams)
        covered = {i + j for i, g in enumerate(grams) if twice[g] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if x.strip()]
        r = rows[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), sum((t or "").count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered),
        )
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
    assert all(rows[k].kept for k in range(200)) and rows[201].kept
    assert not rows[200].kept and not rows[202].kept and not rows[203].kept


def test_broken_markup_is_read_once():
    for page in ("<a " * 300_000, "<p " + "a='b' " * 150_000, "<a '\">x" * 120_000, '<a title="x>y' * 80_000, "<!-" * 300_000):
        before = time.perf_counter()
        html.blocks(page)
        html.blocks("<p>one two</p>" + page)
        assert time.perf_counter() - before < 10
    words = lambda page: [b.text for b in html.blocks(page)]
    assert words("<p title='a>b'>one</p><p title=\"it's>two</p><br/>three<!-- four > five") == ["one", "two", "three"]
    assert words("<p>one > two <!-- three") == ["one > two"] and words("no tag <? x") == ["no tag"] and words("") == []
    assert words("<div data-x='<p>no</p>'>one</div><div/>two < three") == ["one", "two < three"]


def test_html(spark):
    page = (
        "<html><head><title>t</title><script>if (a<b) {'</p>'}</script></head><body><header><a href='/'>Home</a></header><nav><ul>"
        "<li><a href=x>One</a></ul></nav><div class='cookie-notice'>We use many cookies on this fine page of ours, do you agree?</div>"
        "<article><h1>A  title</h1><p>First &amp; best<br>line.<p>Ok.</p><div id=comments><p>A reader wrote this long comment under it.</p></div>"
        "</article><aside>Other things that may be read</aside><form>Your name</form><footer>&copy; us</footer>"
    )
    rows = [(1, "u", page), (None, None, None), (2, "u", ""), (2, "u", "<" * 3000)]
    got = html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert got[0].text == "A title\nFirst & best line.\nOk." and got[0].n_chars == len(got[0].text)
    assert got[1].text == got[2].text == ""
    assert html.extracted(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got == {x: find(x) for x in parent}


def test_near_duplicates(spark):
    r = random.Random(4)
    texts = []
    for k in range(25):
        base = prose(k, 200, 5000).split()
        texts.append(" ".join(base))
        for _ in range(4):
            copy = list(base)
            copy[r.randrange(200)] = "changed"
            texts.append(" ".join(copy))
        texts.append(" ".join(base).upper())
    texts += [texts[0]] * 3
    got = {x.doc_id: x.class_id for x in minhash.near_duplicates(docs(spark, texts)).collect()}
    assert all(got[k] == (k // 6 * 6 if k < 150 else 0) for k in range(153))
    a, b = (minhash.labelled(t, WordCodes()) for t in ("a b c d e f g h", "a b c d e f g x"))
    assert minhash.aligned(a, b, 0.5) == pytest.approx(3 / 5) and minhash.aligned(a, a[::-1].copy()) == 0


def test_near_duplicates_of_a_template(spark):
    r = random.Random(8)
    template = [f"w{r.randrange(5000)}" for _ in range(300)]
    texts = []
    for k in range(300):  # alike to less than 0.8, and each third has a copy that is nearer
        own = list(template)
        for at in r.sample(range(300), 8):
            own[at] = f"own{k}x{at}"
        texts.append(own)
        if k % 3 == 0:
            copy = list(own)
            for at in r.sample(range(300), 4):
                copy[at] = f"new{k}x{at}"
            texts.append(copy)
    r.shuffle(texts)
    found = [minhash.labelled(" ".join(t), WordCodes()) for t in texts]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if minhash.aligned(found[a], found[b]) >= minhash.SIMILARITY:
                low, high = sorted((root[a], root[b]))
                root = [low if x == high else x for x in root]
    got = {x.doc_id: x.class_id for x in minhash.near_duplicates(docs(spark, [" ".join(t) for t in texts])).collect()}
    assert len(set(root)) == 300 and got == dict(enumerate(root))


def test_blocks_of_a_family(spark):
    r = np.random.default_rng(4)
    codes = np.where(r.random((900, minhash.SKETCHES)) < 0.7, 7, r.integers(100, 10**9, (900, minhash.SKETCHES)))
    codes[:40] = codes[0]  # more than a block that no sketch divides
    rows = [(k, k, [int(x) for x in codes[k]]) for k in range(900)] + [(1000 + k, 5, [1] * minhash.SKETCHES) for k in range(50)]
    orders = minhash.sketch_orders(4)
    small, alike = minhash.blocks(spark.createDataFrame(rows, "rep long, root long, sketch array<long>"), orders)
    sets = [{x.rep for x in xs} for xs in by_key(small.collect()).values()]
    assert sets and all(2 <= len(x) <= minhash.BLOCK and max(x) < 900 for x in sets)
    assert {x.rep for x in alike.collect()} == set(range(40))
    want = set()  # the same by plain recursion
    for o in orders:
        todo = [(list(range(900)), 0)]
        while todo:
            ids, depth = todo.pop()
            if depth >= 2 and 2 <= len(ids) <= minhash.BLOCK:
                want.add(frozenset(ids))
            elif len(ids) > 1 and depth < len(o):
                parts = {}
                for k in ids:
                    parts.setdefault(codes[k][o[depth]], []).append(k)
                todo += [(p, depth + 1) for p in parts.values()]
    assert set(map(frozenset, sets)) == want


def test_near_duplicates_of_repeated_ids(spark):
    a, b, c = (prose(k, 120, 5000) for k in (1, 2, 3))
    rows = [(5, a), (5, b), (7, a + " more"), (8, b + " more"), (9, c), (None, c), (None, prose(4, 50, 5000)), (3, None), (2, " ")]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x.doc_id or -1, x.class_id or -1, x.copies) for x in found) == [
        (-1, -1, 1), (-1, 9, 2), (2, 2, 1), (3, 3, 1), (5, 5, 1), (5, 5, 1), (7, 5, 1), (8, 5, 1), (9, 9, 2)
    ]


def by_key(rows):
    out = {}
    for x in rows:
        out.setdefault(x.key, []).append(x)
    return out


def test_passages(spark):
    shared = prose(77, 80, 5000)
    texts = [prose(k, 90, 5000) for k in range(12)]
    for k in (2, 5, 9):
        texts[k] = texts[k] + "\n" + shared + "\n" + prose(100 + k, 30, 5000)
    found = passages.repeated(docs(spark, texts)).collect()
    assert {(r.doc_id, r.start, r.n_words, r.src) for r in found} == {(5, 90, 80, 2), (9, 90, 80, 2)}
    cut = {r.doc_id: r.text for r in passages.without_repeats(docs(spark, texts)).collect()}
    assert cut[2] == texts[2] and shared not in cut[5] and prose(105, 30, 5000) in cut[5]
    assert all(cut[k] == texts[k] for k in range(12) if k not in (5, 9))


def test_passages_with_words_put_in_or_left_out(spark):
    texts, spans = [prose(k, 90, 5000) for k in range(40)], {}
    for k in range(20):
        n = 56 + 2 * k
        shared = prose(500 + k, n, 5000).split()
        edited = [*shared[: n // 2], "put", *shared[n // 2 :]] if k % 2 else [*shared[: n // 2], *shared[n // 2 + 1 :]]
        texts[k] += " " + " ".join(shared) + " " + prose(600 + k, 30, 5000)
        texts[20 + k] += " " + " ".join(edited) + " " + prose(700 + k, 30, 5000)
        spans[20 + k] = (90, len(edited), k)
    found = passages.repeated(docs(spark, texts)).collect()
    assert {r.doc_id: (r.start, r.n_words, r.src) for r in found} == spans and len(found) == 20
    assert all(0.8 <= r.similarity < 1 for r in found)


def test_passages_around_a_common_line(spark):
    """Pairs of exact passages, all around a line that stands earlier, and more pairs than meet at once."""
    line, texts = prose(1, 40, 5000), []
    texts.append(prose(2, 60, 5000) + " " + line + " " + prose(3, 60, 5000))
    for k in range(60):
        shared = prose(1000 + k, 10, 5000) + " " + line + " " + prose(2000 + k, 10, 5000)
        texts += [prose(3000 + 2 * k + j, 70, 5000) + " " + shared + " " + prose(4000 + 2 * k + j, 70, 5000) for j in (0, 1)]
    found = passages.repeated(docs(spark, texts)).collect()  # a word beside a passage may be the same by chance
    found = {(r.doc_id, r.src) for r in found if r.start <= 70 and r.start + r.n_words >= 130}
    assert {(2 * k + 2, 2 * k + 1) for k in range(60)} <= found


def test_compact_windows_cover_every_stretch():
    r = np.random.default_rng(2)
    for h in (r.integers(0, 50, 60).astype(np.uint64), np.zeros(200, np.uint64)):
        found = passages.compact_windows(h, 8)
        for i in range(len(h) - 7):
            for j in range(i + 7, len(h)):
                assert any(lo <= i <= c <= j <= hi and h[c] == h[i : j + 1].min() for lo, c, hi in found)


def test_centres_are_those_of_compact_windows():
    h = np.random.default_rng(3).permutation(500).astype(np.uint64)
    assert passages.centres(h, 20).tolist() == sorted(c for _, c, _ in passages.compact_windows(h, 20))


def test_surrogates(spark):
    texts = [
        "Call +1 (017) 555-7713 or 1-017-555-7713, mail Bo.34@mail7.example.com.",
        "bo.34@mail7.example.com paid with 4539 1488 0343 6467 = 4539148803436467 from 7.88.85.226.",
        "Dr. Anna Weber met Mr. Smith. JOHN SMITH saw Мария Петрова and Frau Weber.",
    ] + [f"a{k % 10}@b.co x{k}@b.co 555-01{k:02d}-99" for k in range(60)]
    got = {r.doc_id: r.text for r in pii.replace_pii(docs(spark, texts)).collect()}
    for secret in ("555-7713", "Bo.34", "bo.34", "4539", "7.88.85.226", "Weber", "Smith", "SMITH", "Мария"):
        assert not any(secret.lower() in (t or "").lower() for t in (got[0], got[1], got[2])) or secret == "4539"
    phone = got[0].split("+1 ")[1][:14]
    assert "".join(c for c in phone if c.isdigit()) in got[0].split(" or 1-")[1].replace("-", "")
    mail = got[0].split("mail ")[1].rstrip(".")
    assert got[1].startswith(mail.lower())
    cards = got[1].split("with ")[1].split(" from")[0].split(" = ")
    assert cards[0].replace(" ", "") == cards[1] and cards[1][0] == "4"
    assert sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(cards[1][::-1])) % 10 == 0
    words = got[2].split()
    assert words[2].rstrip(".") != "" and words[1].endswith("na") and words[-1].rstrip(".") == words[2]
    firsts = {texts[k].split()[0]: got[k].split()[0] for k in range(3, 63)}
    seconds = {texts[k].split()[1]: got[k].split()[1] for k in range(3, 63)}
    both = firsts | seconds  # one-letter mails collide in the first draw; all must differ in the end
    assert len(set(both.values())) == len(both) and not set(both) & set(both.values())


def test_nearest_neighbours(spark):
    r = np.random.default_rng(5)
    centres = r.standard_normal((10, 16))
    x = (centres[r.integers(0, 10, 900)] + 0.4 * r.standard_normal((900, 16))).astype(np.float32)
    x[700:760] = x[0]  # more copies than a list holds
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(1001, None), (1002, [0.0] * 16), (1003, [float("nan")] * 16), (1020, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for n in ann.nearest(table, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(n.query_id, []).append((n.vec_id, n.score))
    x = x.astype(np.float64)
    hits = 0
    for q in range(0, 900, 20):
        score = x @ x[q]
        score[q] = -np.inf
        best = np.lexsort((np.arange(900), -score))[:20]
        hits += len(set(best) & {v for v, _ in got[q]})
        assert all(s == pytest.approx(score[v], abs=1e-12) for v, s in got[q]) and len(got[q]) == 20
    assert set(got) == set(range(0, 900, 20)) and hits >= 0.9 * 20 * 45
    tied = [v for v, _ in got[700] if v == 0 or 700 <= v < 760]
    assert tied == sorted(tied)
    assert ann.nearest(table.limit(0), F.col("vec_id") % 20 == 0).collect() == []


def test_digests_of_nothing(spark):
    row = bpe.digests(docs(spark, [None]), RANKS, public_tokenizers.PATTERN).first()
    assert (row.n_tokens, row.ids_sha256, row.decoded_sha256) == (0, hashlib.sha256(b"").hexdigest(), hashlib.sha256(b"").hexdigest())


def test_pii_without_digits_and_with_few_letters(spark):
    """Secrets of letters alone are found on their own, and addresses of one odd letter come to differ."""
    odd = [f"{c}@b.co" for c in "àâäãåæéèêë"]
    secret = "sk-abcdefghijklmnopqrstuv"
    texts = [f"key {secret} here", f"key {secret} here 1", "AKIA" + "Q" * 16, "abcdef" * 6, "no secrets", *odd]
    rows = {r.doc_id: r for r in pii.replace_pii(docs(spark, texts)).collect()}
    assert [rows[k].n_entities for k in range(5)] == [1, 1, 1, 1, 0]
    assert secret not in rows[0].text and rows[1].text == f"{rows[0].text} 1"
    addresses = {rows[5 + k].text for k in range(len(odd))}
    assert len(addresses) == len(odd) and not addresses & set(odd)


def test_passages_around_a_line_that_a_text_repeats(spark):
    r, salt, run = np.random.default_rng(1), seeds(1, 7)[0], passages.least_run(46)

    def words(n):
        return [f"w{x}" for x in r.integers(0, 10**6, n)]

    def signatures(some):
        found = shingles(coded(" ".join(some), WordCodes()), passages.SIZE)
        return set(found[passages.centres(mix(found ^ salt), run)].tolist())

    line = words(30)
    own = set(shingles(coded(" ".join(line), WordCodes()), passages.SIZE).tolist())
    while True:  # until only signatures of the line bring the two together
        passage = [*words(12), *line, *words(12)]
        two = [[*words(28), *passage, *words(28)] for _ in range(2)]
        if signatures(two[0]) & signatures(two[1]) <= own:
            break
    places = [[*words(r.integers(40, 200)), *line, *words(r.integers(40, 200))] for _ in range(44)]
    places[20], places[38] = two  # neither the first place of the line nor the nearest
    at = np.cumsum([0, *map(len, places)])
    found = passages.repeated(docs(spark, [" ".join(sum(places, []))])).collect()
    assert [(x.src, x.start, x.n_words, x.src_start) for x in found] == [(0, at[38] + 28, 54, at[20] + 28)]


def test_own_pairs():
    at, kind = np.arange(40) * 50, np.arange(40) % 3
    got = set(map(tuple, passages.own_pairs(at, kind, 46).tolist()))
    # all of up to 16, later the first and the nearest of each kind
    assert {(800, 50 * k) for k in range(16)} <= got and {y for x, y in got if x == 1950} == {0, 50, 100, 1800, 1850, 1900}
    some = np.array([(900, 100), (950, 150), (1000, 200), (1000, 100)])
    assert passages.ends_of_shifts(some).tolist() == [[900, 100], [1000, 200], [1000, 100]]


def test_near_duplicates_in_a_family_are_found_exactly(spark):
    r = random.Random(12)
    template = [f"t{k}" for k in range(200)]
    texts = []
    for k in range(260):
        own = [w if r.random() < 0.96 else f"o{k}x{i}" for i, w in enumerate(template)]
        texts.append(own)
    for k in range(0, 60, 2):  # just above the limit
        texts.append([w if r.random() < 0.978 else f"p{k}x{i}" for i, w in enumerate(texts[k])])
    found = [minhash.labelled(" ".join(t), WordCodes()) for t in texts]
    want = {(a, b) for a in range(len(texts)) for b in range(a) if minhash.aligned(found[a], found[b]) >= minhash.SIMILARITY}
    rows = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "rep long, text string")
    none = spark.createDataFrame([], "a long, b long")
    links = minhash.family_links(rows, rows.select("rep", F.col("rep").alias("root")), none, part=4)
    root, want_root = (dict(enumerate(range(len(texts)))) for _ in range(2))
    for got, pairs in ((root, [(x.a, x.b) for df in links for x in df.collect()]), (want_root, sorted(want))):
        assert pairs and {(max(p), min(p)) for p in pairs} <= want
        for a, b in pairs:
            low, high = sorted((got[a], got[b]))
            got.update({k: low for k, x in got.items() if x == high})
    assert root == want_root
    classes = minhash.near_duplicates(rows.withColumnRenamed("rep", "doc_id")).collect()
    assert {x.doc_id: x.class_id for x in classes} == want_root


def test_a_family_that_is_not_alike_enough_makes_few_pairs(spark, monkeypatch):
    """Copies of a text with one other word each: of 45,150 pairs that share rare shingles those alike are aligned, and few others."""
    template = [f"t{k}" for k in range(60)]
    texts = [[f"o{k}" if i == k % 60 else w for i, w in enumerate(template)] for k in range(300)] + [template[:-1]]
    found = [minhash.labelled(" ".join(t), WordCodes()) for t in texts]
    want = {(a, b) for a in range(len(texts)) for b in range(a) if minhash.aligned(found[a], found[b]) >= minhash.SIMILARITY}
    met, old = [], minhash.verified
    monkeypatch.setattr(minhash, "verified", lambda pairs, *args: met.append(pairs.count()) or old(pairs, *args))
    rows = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "rep long, text string")
    links = minhash.family_links(rows, rows.select("rep", F.col("rep").alias("root")), spark.createDataFrame([], "a long, b long"), part=400)
    got = {(max(x.a, x.b), min(x.a, x.b)) for df in links for x in df.collect()}
    assert got == want and len(want) < 12_000
    assert sum(met) < 1.2 * len(want)
    odd = [np.array(x[1:]) for x in minhash.parities(rows).orderBy("rep").collect()]
    for a, b in ((0, 1), (0, 60), (7, 300)):
        bits = np.unpackbits((odd[a] ^ odd[b]).view(np.uint8)).sum()
        assert 0 < bits <= len(np.setxor1d(found[a], found[b]))


def test_passages_in_runs_of_a_word(spark):
    """Runs of a word have two places each, whatever their length; those as long as a passage are found, and within a text too."""
    def run(n):
        return " the" * n

    texts = [prose(k, 60, 5000) + run(30 + 40 * k) + " " + prose(50 + k, 60, 5000) for k in range(3)]
    texts += [prose(9, 20, 5000) + " x" + run(40) + " y", prose(9, 20, 5000) + " z" + run(40) + " v"]
    texts.append(prose(8, 80, 5000) + " od" * 120)
    listed = passages.windows(docs(spark, texts)).where("own < 0").groupBy("doc_id", "v").count().agg(F.max("count")).first()[0]
    assert listed <= 2
    found = {(r.doc_id, r.src, r.start, r.n_words) for r in passages.repeated(docs(spark, texts)).collect()}
    assert {(2, 1, 60, 70), (2, 1, 100, 70), (5, 5, 126, 74)} <= found
    assert any(d == 4 and s == 3 and n >= 60 for d, s, _, n in found)


def test_stretches_cover_all_that_are_alike():
    r = np.random.default_rng(5)
    for _ in range(200):
        same = np.repeat(r.random(60) < 0.6, r.integers(1, 30, 60))
        found, count = np.zeros(len(same), bool), np.r_[0, np.cumsum(same)]
        for a, b, s in passages.stretches(same, 46, 0.8):
            m = count[b] - count[a]
            assert b - a >= 46 and m >= 1.6 / 1.8 * (b - a) - 1e-6 and s == pytest.approx(m / (2 * (b - a) - m))
            found[a:b] = True
        for a in np.flatnonzero(same & ~found):
            ends = np.flatnonzero(np.r_[same, False] & ~np.r_[same[1:], False, False]) + 1
            ends = ends[ends >= a + 46]
            assert not (count[ends] - count[a] >= 1.6 / 1.8 * (ends - a) + 1e-6).any()
