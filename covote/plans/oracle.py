"""SQL that computes what the registered queries compute, in another way, over whole tables.

Written for DuckDB. It builds every matrix in full and compares similarities directly,
without any of the shortcuts the Spark plans take.
"""

from __future__ import annotations

from covote.plans.catalogue import FRONTS, K, N, SEGMENT, SPLIT_DATE, USERS, WORD

LINES = 'SELECT o_custkey AS "user", l_partkey AS item FROM orders JOIN lineitem ON l_orderkey = o_orderkey'
INTER = f"inter AS ({LINES})"
TRAIN = f"train AS ({LINES} WHERE o_orderdate < TIMESTAMP '{SPLIT_DATE}')"
HELD = f"held AS ({LINES} WHERE o_orderdate >= TIMESTAMP '{SPLIT_DATE}')"
RETURNED = f"returned AS ({LINES} WHERE l_returnflag = 'R')"
FULFILLED = f"fulfilled AS ({LINES} WHERE l_linestatus = 'F')"
EVENTS = 'acts AS (SELECT user_id AS "user", event_type AS item FROM events)'
TARGETS = f"targets AS (SELECT c_custkey FROM customer WHERE c_mktsegment = '{SEGMENT}')"


def sims(data: str, name: str = "sims", entity: str = '"user"', basis: str = "item") -> str:
    """CTEs up to ``name(src, dst, sim)``, both directions."""
    return f"""
    {name}_p AS (SELECT DISTINCT {entity} AS e, {basis} AS b FROM {data}),
    {name}_n AS (SELECT e, count(*) AS n FROM {name}_p GROUP BY e),
    {name}_c AS (SELECT x.e AS src, y.e AS dst, count(*) AS common
        FROM {name}_p x JOIN {name}_p y ON x.b = y.b AND x.e <> y.e GROUP BY x.e, y.e),
    {name} AS (SELECT src, dst,
        sqrt(CAST(common * common AS DOUBLE) / CAST(s.n * d.n AS DOUBLE)) AS sim
        FROM {name}_c JOIN {name}_n s ON s.e = src JOIN {name}_n d ON d.e = dst)"""


def item_sims(data: str) -> str:
    return sims(data, "sims", "item", '"user"')


def nbrs(ties: bool = False, source: str = "sims", name: str = "nbrs") -> str:
    rank = (
        "rank() OVER (PARTITION BY src ORDER BY sim DESC)"
        if ties
        else "row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst)"
    )
    return f'{name} AS (SELECT src, dst, sim, CAST({rank} AS INTEGER) AS "rank" FROM {source} QUALIFY {rank} <= {N})'


def user_votes(data: str, source: str = "nbrs") -> str:
    return f"""votes AS (SELECT src AS "user", item, CAST(count(*) AS BIGINT) AS votes
        FROM {source} JOIN {data} i ON i."user" = dst GROUP BY src, item)"""


def item_votes(data: str) -> str:
    return f"""votes AS (SELECT i."user" AS "user", dst AS item, CAST(count(*) AS BIGINT) AS votes
        FROM nbrs JOIN {data} i ON i.item = src GROUP BY i."user", dst)"""


def top(source: str = "votes", name: str = "recs") -> str:
    rank = 'row_number() OVER (PARTITION BY "user" ORDER BY votes DESC, item)'
    return f'{name} AS (SELECT "user", item, votes, CAST({rank} AS INTEGER) AS "rank" FROM {source} QUALIFY {rank} <= {K})'


def select(what: str, *ctes: str) -> str:
    return f"WITH {', '.join(ctes)}\n{what}"


RECS = 'SELECT "user", item, votes, "rank" FROM recs'
RECS_TARGET = RECS + ' WHERE "user" IN (SELECT c_custkey FROM targets)'
RECS_LITERAL = RECS + f' WHERE "user" IN ({", ".join(map(str, USERS))})'
NBRS = 'SELECT src, dst, sim, "rank" FROM nbrs'
VOTES = 'SELECT "user", item, votes FROM votes'


FRESH = """fresh AS (SELECT * FROM votes v WHERE NOT EXISTS
    (SELECT 1 FROM inter i WHERE i."user" = v."user" AND i.item = v.item))"""


def hybrid(data: str, *fresh: str) -> list[str]:
    """CTEs up to ``recs``: both lists in full, then votes over them."""
    last = (*fresh, top("fresh" if fresh else "votes"))
    user = select('SELECT "user", item FROM recs', sims(data), nbrs(), user_votes(data), *last)
    item = select('SELECT "user", item FROM recs', item_sims(data), nbrs(), item_votes(data), *last)
    return [
        f"both_lists AS (SELECT * FROM ({user}) UNION ALL SELECT * FROM ({item}))",
        'votes AS (SELECT "user", item, CAST(count(*) AS BIGINT) AS votes FROM both_lists GROUP BY "user", item)',
        top(),
    ]


def feats(count: int) -> list[str]:
    """CTEs up to ``feats(src, dst, f0, …)``."""
    ctes, joined = [INTER, sims("inter", "s0")], "s0"
    columns = ["s0.sim AS f0"]
    for i, (cte, data) in enumerate(((RETURNED, "returned"), (FULFILLED, "fulfilled"))[: count - 1], 1):
        ctes += [cte, sims(data, f"s{i}")]
        joined += f" FULL JOIN s{i} USING (src, dst)"
        columns.append(f"s{i}.sim AS f{i}")
    return [*ctes, f"feats AS (SELECT src, dst, {', '.join(columns)} FROM {joined})"]


def fronts(count: int, missing: str, rounds: int) -> list[str]:
    """CTEs up to ``found(src, dst, layer)``: the rounds as written, on distinct vectors."""
    cols = [f"f{i}" for i in range(count)]
    value = "coalesce({c}, 0.0)" if missing == "zero" else "{c}"
    points = ", ".join(f"{value.format(c=c)} AS {c}" for c in cols)
    never_below = " AND ".join(f"coalesce(q.{c} >= p.{c}, true)" for c in cols)
    once_above = " OR ".join(f"coalesce(q.{c} > p.{c}, false)" for c in cols)
    same = " AND ".join(f"{{a}}.{c} IS NOT DISTINCT FROM {{b}}.{c}" for c in cols)
    listed = ", ".join(cols)
    ctes = [
        f"points AS (SELECT src, dst, {points} FROM feats)",
        f"left1 AS MATERIALIZED (SELECT src, {listed}, count(*) AS members FROM points GROUP BY src, {listed})",
    ]
    for r in range(1, rounds + 1):
        ctes.append(
            f"""front{r} AS MATERIALIZED (SELECT p.*, {r} AS layer FROM left{r} p WHERE NOT EXISTS
            (SELECT 1 FROM left{r} q WHERE q.src = p.src AND {never_below} AND ({once_above})))"""
        )
        so_far = " UNION ALL ".join(f"SELECT src, members FROM front{i}" for i in range(1, r + 1))
        ctes.append(
            f"""left{r + 1} AS MATERIALIZED (SELECT l.* FROM left{r} l
            JOIN (SELECT src, sum(members) AS chosen FROM ({so_far}) GROUP BY src) c ON c.src = l.src
            WHERE chosen < {rounds} AND NOT EXISTS
            (SELECT 1 FROM front{r} f WHERE f.src = l.src AND {same.format(a="f", b="l")}))"""
        )
    every = " UNION ALL ".join(f"SELECT src, {listed}, layer FROM front{r}" for r in range(1, rounds + 1))
    ctes.append(
        f"""found AS (SELECT p.src, p.dst, CAST(v.layer AS INTEGER) AS layer FROM points p
        JOIN ({every}) v ON v.src = p.src AND {same.format(a="v", b="p")})"""
    )
    return ctes


FOUND = "SELECT src, dst, layer FROM found"


def preselected(count: int) -> list[str]:
    """CTEs like ``feats``, with the features of all but the N most similar of each absent."""
    cols = [f"f{i}" for i in range(count)]
    ranked = ", ".join(
        f"CASE WHEN rank() OVER (PARTITION BY src ORDER BY {c} DESC NULLS LAST) <= {N} THEN {c} END AS {c}" for c in cols
    )
    *ctes, last = feats(count)
    return [
        *ctes,
        last.replace("feats AS", "every_pair AS", 1),
        f"kept AS (SELECT src, dst, {ranked} FROM every_pair)",
        f"feats AS (SELECT * FROM kept WHERE {' OR '.join(f'{c} IS NOT NULL' for c in cols)})",
    ]


def witnesses(missing: str) -> str:
    """Every dominator of every distinct vector is compared, and the one that is to be named comes first."""
    value = "coalesce({c}, 0.0)" if missing == "zero" else "{c}"
    return select(
        "SELECT p.src, p.dst, n.by FROM points p JOIN named n ON n.src = p.src "
        "AND n.f0 IS NOT DISTINCT FROM p.f0 AND n.f1 IS NOT DISTINCT FROM p.f1",
        *feats(2),
        f"points AS (SELECT src, dst, {value.format(c='f0')} AS f0, {value.format(c='f1')} AS f1 FROM feats)",
        "vectors AS MATERIALIZED (SELECT src, f0, f1, min(dst) AS id FROM points GROUP BY src, f0, f1)",
        """named AS (SELECT p.src, p.f0, p.f1, q.id AS by FROM vectors p JOIN vectors q ON p.src = q.src
            AND coalesce(q.f0 >= p.f0, true) AND coalesce(q.f1 >= p.f1, true)
            AND (coalesce(q.f0 > p.f0, false) OR coalesce(q.f1 > p.f1, false))
            QUALIFY row_number() OVER (PARTITION BY p.src, p.f0, p.f1 ORDER BY
                CASE WHEN p.f0 IS NULL OR p.f1 IS NULL OR (q.f0 IS NOT NULL AND q.f1 IS NOT NULL) THEN 0
                     WHEN q.f1 IS NULL THEN 1 ELSE 2 END,
                CASE WHEN p.f1 IS NULL OR q.f1 IS NULL THEN q.f0 ELSE q.f1 END DESC,
                CASE WHEN p.f0 IS NOT NULL AND p.f1 IS NOT NULL AND q.f1 IS NOT NULL THEN q.f0 END DESC NULLS LAST,
                q.id) = 1)""",
    )


def evaluation(*ctes: str) -> str:
    """Metrics of ``recs`` against ``held``."""
    nan = "CAST('NaN' AS DOUBLE)"
    return select(
        f"""SELECT tp, fp, tn, fn, "precision", recall,
        CASE WHEN isnan("precision") OR isnan(recall) OR "precision" + recall = 0 THEN {nan}
             ELSE 2 * "precision" * recall / ("precision" + recall) END AS f1,
        CASE WHEN tp + fp + fn = 0 THEN {nan} ELSE (tp + tn) / (tp + tn + fp + fn) END AS accuracy
        FROM parts""",
        *ctes,
        'hit AS (SELECT "user", item FROM recs INTERSECT SELECT "user", item FROM held)',
        """counted AS (SELECT CAST((SELECT count(*) FROM hit) AS DOUBLE) AS tp,
            CAST((SELECT count(*) FROM recs) AS DOUBLE) AS n_recs,
            CAST((SELECT count(*) FROM held) AS DOUBLE) AS n_held)""",
        f"""parts AS (SELECT tp, n_recs - tp AS fp, CAST(0 AS DOUBLE) AS tn, n_held - tp AS fn,
            CASE WHEN n_recs = 0 THEN {nan} ELSE tp / n_recs END AS "precision",
            CASE WHEN n_held = 0 THEN {nan} ELSE tp / n_held END AS recall FROM counted)""",
    )


def statements() -> dict[str, str]:
    user_cf = [sims("inter"), nbrs(), user_votes("inter"), top()]
    item_cf = [item_sims("inter"), nbrs(), item_votes("inter"), top()]
    trained = [TRAIN, HELD, sims("train"), nbrs(), user_votes("train"), top()]
    same_rows = select('SELECT "user", item FROM inter', INTER)
    mo = [*fronts(2, "shared", FRONTS), user_votes("inter", "found"), top()]
    mo_zero = [*fronts(2, "zero", FRONTS), user_votes("inter", "found"), top()]
    user_evaluation = evaluation(*trained)
    return {
        "read_wide": same_rows,
        "read_wide_rejects": select(
            """SELECT 'u' || "user" AS token, 'user' AS reason, lines AS times, 0::BIGINT AS pairs FROM per WHERE "user" % 50 = 0
            UNION ALL SELECT t, r, sum(lines)::BIGINT, 0 FROM per, (VALUES ('12 ', 'item'), ('', 'item'),
                ('99999999999999999999', 'item range')) v(t, r) WHERE "user" % 50 = 1 GROUP BY t, r
            UNION ALL SELECT NULL, NULL, sum(n)::BIGINT, sum(n)::BIGINT FROM per WHERE "user" % 50 <> 0""",
            INTER, 'per AS (SELECT "user", count(*) AS n, (count(*) + 19) // 20 AS lines FROM inter GROUP BY "user")',
        ),
        "write_pairs": same_rows,
        "replay_chunks": same_rows,
        "replay_neighbours": select(NBRS, INTER, sims("inter"), nbrs()),
        "replay_recommendations": select(RECS, INTER, *user_cf),
        "chunk_by_user": select(
            """SELECT "user", item, CAST((row_number() OVER (PARTITION BY "user" ORDER BY item) - 1) // 20 + 1
            AS INTEGER) AS chunk FROM inter""",
            INTER,
        ),
        "number_chunks": select(
            'SELECT "user", item, 0 AS chunk FROM train UNION ALL SELECT "user", item, 1 FROM held', TRAIN, HELD
        ),
        "interaction_counts": select(
            'SELECT "user", item, count(*) AS times FROM inter GROUP BY "user", item', INTER
        ),
        "target_users": select('SELECT DISTINCT "user" FROM inter', INTER),
        "id_bounds": select('SELECT max("user") AS max_user, max(item) AS max_item FROM inter', INTER),
        "sum_values": "SELECT CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem",
        "count_containing": f"SELECT count(*) AS lines FROM part WHERE contains(p_name, '{WORD}')",
        "left_outer_interactions": select(
            'SELECT c_custkey AS "user", coalesce(item, \'none\') AS item FROM customer LEFT JOIN acts ON acts."user" = c_custkey', EVENTS
        ),
        "popular_items": select(
            f"SELECT item, count(*) AS votes FROM inter GROUP BY item ORDER BY votes DESC, item LIMIT {K}", INTER
        ),
        "cooccurrence": select("SELECT src, dst, common FROM sims_c WHERE src < dst", INTER, sims("inter")),
        "user_similarity": select("SELECT src, dst, sim FROM sims", INTER, sims("inter")),
        "item_similarity": select("SELECT src, dst, sim FROM sims", INTER, item_sims("inter")),
        "user_neighbours": select(NBRS, INTER, sims("inter"), nbrs()),
        "item_neighbours": select(NBRS, INTER, item_sims("inter"), nbrs()),
        "user_neighbours_target": select(
            NBRS + " WHERE src IN (SELECT c_custkey FROM targets)", INTER, TARGETS, sims("inter"), nbrs()
        ),
        "item_neighbours_target": select(
            NBRS + ' WHERE src IN (SELECT item FROM inter JOIN targets ON c_custkey = "user")',
            INTER, TARGETS, item_sims("inter"), nbrs(),
        ),
        "neighbours_with_ties": select(NBRS, INTER, sims("inter"), nbrs(ties=True)),
        "event_neighbours_with_ties": select(NBRS, EVENTS, sims("acts"), nbrs(ties=True)),
        "user_votes": select(VOTES, INTER, *user_cf[:3]),
        "item_votes": select(VOTES, INTER, *item_cf[:3]),
        "rec_user_cf": select(RECS, INTER, *user_cf),
        "rec_user_cf_target": select(RECS_TARGET, INTER, TARGETS, *user_cf),
        "rec_user_cf_unseen": select(
            RECS, INTER, *user_cf[:3],
            FRESH, top("fresh"),
        ),
        "rec_user_cf_other_data": select(RECS, TRAIN, HELD, sims("train"), nbrs(), user_votes("held"), top()),
        "rec_item_cf": select(RECS, INTER, *item_cf),
        "rec_item_cf_target": select(RECS_TARGET, INTER, TARGETS, *item_cf),
        "rec_item_cf_other_data": select(RECS, TRAIN, HELD, item_sims("train"), nbrs(), item_votes("held"), top()),
        "user_neighbours_literal": select(
            NBRS + f" WHERE src IN ({', '.join(map(str, USERS))})", INTER, sims("inter"), nbrs()
        ),
        "item_neighbours_literal": select(
            NBRS + f""" WHERE src IN (SELECT item FROM inter WHERE "user" IN ({", ".join(map(str, USERS))}))""",
            INTER, item_sims("inter"), nbrs(),
        ),
        "rec_user_cf_literal": select(RECS_LITERAL, INTER, *user_cf),
        "rec_item_cf_literal": select(RECS_LITERAL, INTER, *item_cf),
        "rec_hybrid_literal": select(RECS_LITERAL, INTER, *hybrid("inter")),
        "rec_multi_objective_literal": select(RECS_LITERAL, *feats(2), *mo),
        "rec_item_cf_unseen": select(RECS, INTER, *item_cf[:3], FRESH, top("fresh")),
        "rec_hybrid_unseen": select(RECS, INTER, *hybrid("inter", FRESH)),
        "rec_hybrid": select(RECS, INTER, *hybrid("inter")),
        "rec_hybrid_target": select(RECS_TARGET, INTER, TARGETS, *hybrid("inter")),
        "feature_similarity": select("SELECT src, dst, f0, f1 FROM feats", *feats(2)),
        "feature_text": select(
            """SELECT src, dst, 0 AS feature, f0 AS sim FROM feats WHERE f0 IS NOT NULL
            UNION ALL SELECT src, dst, 1, f1 FROM feats WHERE f1 IS NOT NULL""",
            *feats(2),
        ),
        "most_similar": select(
            "SELECT src, dst, f0, f1 FROM kept WHERE f0 IS NOT NULL OR f1 IS NOT NULL",
            *feats(2),
            f"""kept AS (SELECT src, dst,
            CASE WHEN rank() OVER (PARTITION BY src ORDER BY f0 DESC NULLS LAST) <= {N} THEN f0 END AS f0,
            CASE WHEN rank() OVER (PARTITION BY src ORDER BY f1 DESC NULLS LAST) <= {N} THEN f1 END AS f1
            FROM feats)""",
        ),
        "pareto_front": select("SELECT src, dst FROM found", *feats(2), *fronts(2, "shared", 1)),
        "dominated_candidates": select(
            "SELECT src, dst FROM feats EXCEPT SELECT src, dst FROM found", *feats(2), *fronts(2, "shared", 1)
        ),
        "dominance_pairs": witnesses("shared"),
        "dominance_pairs_zero": witnesses("zero"),
        "mo_neighbours_preselected": select(FOUND, *preselected(2), *fronts(2, "shared", FRONTS)),
        "rec_multi_objective_preselected": select(RECS, *preselected(2), *mo),
        "mo_neighbours_one_feature": select(FOUND, *feats(1), *fronts(1, "shared", FRONTS)),
        "mo_neighbours_shared": select(FOUND, *feats(2), *fronts(2, "shared", FRONTS)),
        "mo_neighbours_zero": select(FOUND, *feats(2), *fronts(2, "zero", FRONTS)),
        "mo_neighbours_three_features": select(FOUND, *feats(3), *fronts(3, "zero", FRONTS)),
        "neighbour_counts": select(
            "SELECT src, count(*) AS neighbours FROM found GROUP BY src", *feats(2), *fronts(2, "zero", FRONTS)
        ),
        "rec_multi_objective": select(RECS, *feats(2), *mo),
        "rec_multi_objective_zero": select(RECS, *feats(2), *mo_zero),
        "rec_multi_objective_target": select(RECS_TARGET, TARGETS, *feats(2), *mo),
        "rec_hits": select(
            'SELECT "user", item FROM recs INTERSECT SELECT "user", item FROM held', *trained
        ),
        "unseen_items": select(
            'SELECT "user", item FROM recs EXCEPT SELECT "user", item FROM inter', INTER, *trained
        ),
        "evaluate_user_cf": user_evaluation,
        "evaluate_item_cf": evaluation(TRAIN, HELD, item_sims("train"), nbrs(), item_votes("train"), top()),
        "evaluate_hybrid": evaluation(TRAIN, HELD, *hybrid("train")),
        "evaluate_multi_objective": evaluation(
            TRAIN, HELD, sims("train", "s0"), "feats AS (SELECT src, dst, sim AS f0 FROM s0)",
            *fronts(1, "shared", FRONTS), user_votes("train", "found"), top(),
        ),
        "evaluation_report": f'''SELECT 7 AS "values", tp, fp, tn, fn, "precision", recall, f1 FROM ({user_evaluation})''',
    }
