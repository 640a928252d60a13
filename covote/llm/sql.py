"""The results of operators as SQL, where it can say them."""

from __future__ import annotations

from covote.llm.mixing import SHARE, REPEATS, WEIGHTS

SPACE = r"\x20\x09-\x0D"


def mixing() -> str:
    weight = " ".join(f"WHEN {k} THEN {w}" for k, w in enumerate(WEIGHTS))
    return f"""
    WITH d AS (
        SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^{SPACE}]+'))::BIGINT AS size,
            md5('0:' || coalesce(doc_id::VARCHAR, '-') || ':' || md5(coalesce(text, ''))) AS key
        FROM documents
    ), s AS (
        SELECT source, sum(size)::BIGINT AS source_size,
            CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} {weight} END::BIGINT AS weight
        FROM d GROUP BY source
    ), l AS (
        SELECT *, {REPEATS} * source_size AS cap,
            coalesce(sum({REPEATS} * source_size) OVER before, 0)::DOUBLE AS caps_before,
            coalesce(sum(weight) OVER before, 0)::BIGINT AS weight_before
        FROM s
        WINDOW before AS (ORDER BY {REPEATS} * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    ), f AS (
        SELECT max((t.words * {SHARE} - caps_before) / (t.weights - weight_before)::DOUBLE) AS level
        FROM l, (SELECT sum(source_size)::DOUBLE AS words, sum(weight)::BIGINT AS weights FROM s) t
    ), g AS (
        SELECT source, source_size, least(cap::DOUBLE, weight * (SELECT level FROM f)) AS target FROM l
    ), p AS (
        SELECT doc_id, size, source_size, target, floor(target)::BIGINT AS budget,
            coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
        FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
    ), e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM p)
    SELECT doc_id, size, source_size, target,
        (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::BIGINT AS taken
    FROM e"""


#: Levels of 8-way runs that the statement folds: enough for 8^8 rows of one language.
LEVELS = 8


def manifest() -> str:
    def leaf(text):
        fields = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
        return "sha256(" + " || ".join(f"coalesce(strlen({c})::VARCHAR || ':' || {c}, '-')" for c in fields) + ")"

    # one shift of the checksum per -1, one byte per other number
    bits = "list_prepend(4294967295, flatten(list_transform(range(1, len(doc_id::VARCHAR) + 1), lambda k: [ascii(substr(doc_id::VARCHAR, k, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])))"
    crc = f"xor(list_reduce({bits}, lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)"

    def tree(name, first, by):
        """Nodes of every level with what stands left and right of them in their run."""
        part = f"PARTITION BY {by + ', ' if by else ''}i // 8 ORDER BY i"
        parts = [f"{name}n0 AS ({first})"]
        for k in range(LEVELS):
            sides = f"""{name}s{k} AS (
                SELECT *, coalesce(string_agg(h, '') OVER ({part} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft,
                    coalesce(string_agg(h, '') OVER ({part} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt
                FROM {name}n{k})"""
            up = f"""{name}n{k + 1} AS (
                SELECT {by + ', ' if by else ''}i // 8 AS i, max((n + 7) // 8) AS n,
                    CASE WHEN max(n) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h
                FROM {name}n{k} GROUP BY {by + ', ' if by else ''}i // 8)"""
            parts += [sides, up]
        return ",\n".join(parts)

    def climb(name, cur, index, by):
        """Folds column ``cur`` up the tree ``name`` and gathers the siblings."""
        steps = []
        for k in range(LEVELS):
            on = f"{name}s{k}.i = {cur}.{index} // {8**k}" + (f" AND {name}s{k}.lang IS NOT DISTINCT FROM {cur}.lang" if by else "")
            steps.append(f"""{name}c{k} AS (
                SELECT {cur}.* REPLACE (proof || lft || rgt AS proof,
                    CASE WHEN {name}s{k}.n = 1 THEN folded ELSE sha256(lft || folded || rgt) END AS folded)
                FROM {cur} JOIN {name}s{k} ON {on})""")
            cur = f"{name}c{k}"
        return ",\n".join(steps), cur

    lower, last = climb("t", "d", "i", "lang")
    upper, end = climb("r", "m", "li", "")
    return f"""
    WITH h AS (
        SELECT doc_id, lang, {leaf('text')} AS leaf,
            CASE WHEN {crc} % 3 = 0 THEN {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS tampered
        FROM documents
    ), d AS (
        SELECT doc_id, lang, leaf, coalesce(tampered, leaf) AS folded, '' AS proof,
            row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
            count(*) OVER (PARTITION BY lang) AS n
        FROM h
    ), {tree("t", "SELECT lang, i, n, leaf AS h FROM d", "lang")},
    {tree("r", f"SELECT row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n, h FROM tn{LEVELS}", "")},
    {lower},
    m AS (
        SELECT c.*, u.h AS subroot, u.li FROM {last} c
        JOIN (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS li FROM tn{LEVELS}) u
        ON c.lang IS NOT DISTINCT FROM u.lang
    ), {upper}
    SELECT doc_id, leaf, subroot, (SELECT h FROM rn{LEVELS}) AS root, sha256(proof) AS proof_sha256,
        folded AS folded_root, folded = (SELECT h FROM rn{LEVELS}) AS verified
    FROM {end}"""
