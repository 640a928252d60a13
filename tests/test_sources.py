"""Files, chunks, the stream and the metrics."""

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import covote
from covote import Skew


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_wide_lines_are_parsed(spark):
    got = rows_of(covote.parse_wide(lines(spark, "1,5,6", "2", "3,7,", "-4,-9", "5,8,8")))
    assert got == Counter([(1, 5), (1, 6), (3, 7), (-4, -9), (5, 8), (5, 8)])


@pytest.mark.parametrize("bad", ["1 ,2", "1,,2", "x,1", "1,2.5", "1,99999999999999999999"])
def test_malformed_lines(spark, bad):
    with pytest.raises(Exception, match="not an id"):
        covote.parse_wide(lines(spark, bad)).collect()
    kept = rows_of(covote.parse_wide(lines(spark, bad, "7,8"), "DROPMALFORMED"))
    assert kept - Counter([(1, 2)]) == Counter([(7, 8)])
    with pytest.raises(ValueError):
        covote.parse_wide(lines(spark, bad), "PERMISSIVE")


def test_rejected_tokens_keep_their_file_and_reason(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1,2,3\n2,,x,7,\nboss,1,2\n\n3\n 4,5\n99999999999999999999,1\n")
    (tmp_path / "b.txt").write_text("5,-6,+7,1.5,99999999999999999999\n")
    got = [(r.user, r.item, r.token, r.reason, r.file[-5:]) for r in covote.read_wide_checked(spark, str(tmp_path)).collect()]
    assert Counter(g for g in got if g[3] is None) == Counter(
        [(1, 2, None, None, "a.txt"), (1, 3, None, None, "a.txt"), (2, 7, None, None, "a.txt"), (5, -6, None, None, "b.txt"), (5, 7, None, None, "b.txt")]
    )
    assert Counter(g[2:] for g in got if g[3]) == Counter(
        [("", "item", "a.txt"), ("x", "item", "a.txt"), ("boss", "user", "a.txt"), ("", "user", "a.txt"), (" 4", "user", "a.txt"),
         ("99999999999999999999", "user range", "a.txt"), ("1.5", "item", "b.txt"), ("99999999999999999999", "item range", "b.txt")]
    )
    assert all(g[0] is None and g[1] is None for g in got if g[3])
    dropped = covote.read_wide(spark, str(tmp_path), "DROPMALFORMED")
    assert rows_of(dropped) == Counter(g[:2] for g in got if g[3] is None)


def chunked_rows(size):
    rows = [(1, i) for i in range(0, 300, 3)] + [(2, 10**12 + i * i) for i in range(47)] + [(3, -4)]
    rows += [(5, i) for i in (-(2**63), 2**63 - 1, 0, 1, 2, -(2**62), 2**62, 3)]
    rows += [(4, 7)] * (2 * size + 3) + [(4, 9)] * 2 + [(1, 0)] * 3
    return rows


@pytest.mark.parametrize("skew", [Skew(), Skew(block=4)], ids=str)
def test_chunks(spark, skew):
    size = 5
    expected = Counter()
    by_user = defaultdict(list)
    for u, i in chunked_rows(size):
        by_user[u].append(i)
    for u, items in by_user.items():
        for place, i in enumerate(sorted(items)):
            expected[u, i, place // size + 1] += 1
    got = covote.chunk_by_user(covote.from_rows(spark, chunked_rows(size)), size, skew=skew)
    assert rows_of(got) == expected


def test_far_ids_do_not_empty_the_stretches(spark):
    """Dense ids and one far from them: the cuts are at quantiles, not at equal widths."""
    from covote.operators.similarity import interaction_counts
    from covote.sources.chunks import stretches

    rows = spark.range(20_000).selectExpr("1L AS user", "id AS item").unionByName(
        covote.from_rows(spark, [(1, 2**62), (2, 5), (2, 2**62)])
    )
    placed = stretches(interaction_counts(rows), Skew(block=1000)).groupBy("user", "stretch").count().collect()
    sizes = {(r["user"], r["stretch"]): r["count"] for r in placed}
    assert sum(sizes.values()) == 20_003 and sizes[2, 0] == 2
    mine = [n for (u, _), n in sizes.items() if u == 1]
    assert len(mine) >= 20 and max(mine) <= 1100
    got = covote.chunk_by_user(rows, 7, skew=Skew(block=1000)).where("user = 1")
    plain = covote.chunk_by_user(rows, 7).where("user = 1")
    assert got.exceptAll(plain).count() == 0 and plain.exceptAll(got).count() == 0


def test_chunks_round_trip_and_replay(spark, tmp_path):
    rows = chunked_rows(5)
    chunked = covote.chunk_by_user(covote.from_rows(spark, rows), 5)
    covote.write_chunks(chunked, str(tmp_path / "chunks"))
    covote.wide_lines(chunked).write.text(str(tmp_path / "wide"))
    assert rows_of(covote.read_wide(spark, str(tmp_path / "wide"))) == Counter(rows)

    store, seen = str(tmp_path / "store"), []

    def refresh(so_far, batch_id):
        seen.append((batch_id, so_far.count()))

    def replay(checkpoint):
        stream = covote.chunk_stream(spark, str(tmp_path / "chunks"), files_per_batch=20)
        covote.replay_chunks(stream, store, str(tmp_path / checkpoint), refresh=refresh).awaitTermination()

    replay("first")
    assert rows_of(covote.stored_interactions(spark, store)) == Counter(rows)
    assert len(seen) > 1 and seen[-1][1] == len(rows)
    assert [n for _, n in seen] == sorted(n for _, n in seen)
    replay("lost")  # all batches again, as after a lost checkpoint
    assert rows_of(covote.stored_interactions(spark, store)) == Counter(rows)
    again = covote.recommend_user(covote.stored_interactions(spark, store), 2, 3)
    assert rows_of(again) == rows_of(covote.recommend_user(covote.from_rows(spark, rows), 2, 3))


def test_chunks_are_added_in_order(spark, tmp_path):
    """Several writer tasks and touched files; a batch that is replayed changes nothing; lists equal those of all rows."""
    rows = chunked_rows(5) + [(u, i) for u in range(10, 30) for i in range(u % 7, 40, 3)]
    chunked = covote.chunk_by_user(covote.from_rows(spark, rows), 5)
    chunked.repartition(3, "user").write.partitionBy("chunk").parquet(str(tmp_path / "chunks"))
    for folder in sorted((tmp_path / "chunks").glob("chunk=*"), key=lambda p: -int(p.name[6:])):
        for file in folder.glob("*.parquet"):
            file.touch()  # the first chunk is the youngest
    store, seen = covote.SimilarityStore(str(tmp_path / "store")).create(spark), []

    def take(batch, version):
        seen.append((version, {r[0] for r in batch.select("chunk").distinct().collect()}))
        store.add(batch, version)

    def replay(checkpoint):
        return covote.replay_in_order(spark, str(tmp_path / "chunks"), str(tmp_path / checkpoint), take, chunks_per_batch=4)

    versions = replay("first")
    assert [v for v, _ in seen] == versions == sorted(versions) and len(versions) > 2
    flat = [c for _, batch in seen for c in sorted(batch)]
    assert flat == sorted(flat) == sorted({r["chunk"] for r in chunked.collect()})
    whole = covote.from_rows(spark, rows)

    def same(got, expected):
        assert rows_of(got) == rows_of(expected)

    same(store.interactions(spark), whole)
    same(store.cooccurrence(spark), covote.cooccurrence(whole, "user", "item"))
    same(store.neighbours(spark, 3), covote.user_neighbours(whole, 3))
    middle = versions[len(versions) // 2]
    so_far = chunked.where(F.col("chunk") <= middle).select("user", "item")
    same(store.neighbours(spark, 3, up_to=middle), covote.user_neighbours(so_far, 3))
    assert replay("first") == versions and len(seen) == len(versions)  # nothing is taken twice
    store.add(chunked.where(F.col("chunk") > versions[-2]), versions[-1])  # as after a failure in the last batch
    same(store.neighbours(spark, 3, ties=True, targets=[1, 12]), covote.user_neighbours(whole, 3, ties=True, targets=[1, 12]))


def test_write_pairs_appends(spark, tmp_path):
    pairs = covote.from_rows(spark, [(1, 2), (3, 4)])
    for _ in range(2):
        covote.write_pairs(pairs, str(tmp_path / "out"), format="csv")
    assert rows_of(spark.read.schema("user long, item long").csv(str(tmp_path / "out"))) == Counter({(1, 2): 2, (3, 4): 2})
    numbered = covote.number_chunks([pairs, pairs.where("user = 3")])
    covote.write_pairs(numbered, str(tmp_path / "parts"), partition_by=["chunk"])
    assert sorted(p.name for p in (tmp_path / "parts").glob("chunk=*")) == ["chunk=0", "chunk=1"]
    with pytest.raises(ValueError):
        covote.number_chunks([])


def test_evaluation_counts_rows_but_hits_once(spark):
    recs = covote.from_rows(spark, [(1, 1), (1, 1), (1, 2), (2, 5)])
    held = covote.from_rows(spark, [(1, 1), (1, 1), (1, 1), (2, 6)])
    row = covote.evaluate(recs, held).first()
    assert (row["tp"], row["fp"], row["tn"], row["fn"]) == (1.0, 3.0, 0.0, 3.0)
    assert rows_of(covote.hits(recs, held)) == Counter([(1, 1)])
    assert rows_of(covote.unseen(recs, held)) == Counter([(1, 2), (2, 5)])


def test_undefined_metrics_are_nan(spark):
    some, none = covote.from_rows(spark, [(1, 1)]), covote.from_rows(spark, [])
    other = covote.from_rows(spark, [(1, 2)])
    empty = covote.evaluate(none, none).first()
    assert all(math.isnan(empty[c]) for c in ("precision", "recall", "f1", "accuracy"))
    miss = covote.evaluate(some, other).first()
    assert (miss["precision"], miss["recall"]) == (0.0, 0.0) and math.isnan(miss["f1"])
    half = covote.evaluate(none, other).first()
    assert math.isnan(half["precision"]) and half["recall"] == 0.0 and math.isnan(half["f1"])


def test_texts_and_bounds(spark):
    df = spark.createDataFrame([(1, 0.5), (None, 0.25), (2, None), (None, None)], "f int, s double")
    got = [r[0] for r in df.select(covote.feature_text(F.col("f"), F.col("s"))).collect()]
    assert got == ["1 , 0.5", "NULL , 0.25", "2 , NULL", "NULL , NULL"]
    assert tuple(covote.id_bounds(covote.from_rows(spark, [(1, 9), (7, 2)]), ["user", "item"]).first()) == (7, 9)
