"""SQL of the boosted ranker, for DuckDB: the rounds and levels of a model spelled out as tables."""

from __future__ import annotations

from tessera.operators import boosting as bo

BUCKET = f"CASE WHEN x > 0 THEN {bo.SPAN} + floor(ln(abs(x)) / ln({bo.GROWTH}))::BIGINT WHEN x < 0 THEN -({bo.SPAN} + floor(ln(abs(x)) / ln({bo.GROWTH}))::BIGINT) ELSE 0 END"
UPPER = f"CASE WHEN bucket = 0 THEN 0 WHEN bucket > 0 THEN pow({bo.GROWTH}, bucket - {bo.SPAN} + 1) ELSE -pow({bo.GROWTH}, -bucket - {bo.SPAN}) END"


def edges_sql(name: str, rows: str, features: list[str], bins: int) -> str:
    """Table ``name``: feature, bucket, at."""
    values = " UNION ALL ".join(f"SELECT {k} AS feature, {f}::DOUBLE AS x FROM {rows} WHERE isfinite({f}::DOUBLE)" for k, f in enumerate(features))
    return f"""{name} AS MATERIALIZED (SELECT feature, bucket, {UPPER} AS at_most FROM (
        SELECT feature, bucket, n, sum(n) OVER (PARTITION BY feature ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY feature) AS total
        FROM (SELECT feature, {BUCKET} AS bucket, count(*) AS n FROM ({values}) GROUP BY ALL))
        WHERE upto * {bins} // total > (upto - n) * {bins} // total AND upto < total)"""


def derivatives_sql(rows: str) -> str:
    """``rows`` (query_id, label, s, ...) with g and h."""
    u = bo.UNIT
    return f"""(SELECT *, CASE WHEN label <> 1 THEN coalesce(round(p * {u})::BIGINT, 0) WHEN stands THEN -(coalesce(sg, 0) // share) ELSE 0 END AS g,
        CASE WHEN label <> 1 THEN coalesce(round(p * (1 - p) * {u})::BIGINT, 0) WHEN stands THEN coalesce(sh, 0) // share ELSE 0 END AS h
        FROM (SELECT *, sum(CASE WHEN label <> 1 THEN round(p * {u})::BIGINT END) OVER q AS sg, sum(CASE WHEN label <> 1 THEN round(p * (1 - p) * {u})::BIGINT END) OVER q AS sh, count(CASE WHEN stands THEN 1 END) OVER q AS share
        FROM (SELECT *, 1 / (1 + exp(gold - s)) AS p, coalesce(label = 1 AND s = gold, FALSE) AS stands FROM (SELECT *, max(CASE WHEN label = 1 THEN s END) OVER (PARTITION BY query_id) AS gold FROM {rows})) WINDOW q AS (PARTITION BY query_id)))"""


def model_sql(name: str, rows: str, features: list[str], s: bo.Settings, start: str | None = None, first: int = 0) -> list[str]:
    """Tables of a model over the table ``rows`` (query_id, pos, label, taught, features): ``{name}_s{r}`` with s after r
    rounds (training rows have ``taught``), ``{name}_t{r}`` with the nodes of round r that split.

    ``start``: a table query_id, pos, s to go on from.
    """
    u, k = bo.UNIT, range(len(features))
    bins = ", ".join(f"CASE WHEN isfinite({f}::DOUBLE) THEN len(list_filter(coalesce((SELECT list(at_most) FROM {name}_e WHERE feature = {i}), []), lambda e: e < {f}::DOUBLE)) ELSE -1 END AS b{i}" for i, f in enumerate(features))
    least = int(s.min_child_weight * u)
    out = [edges_sql(f"{name}_e", f"(SELECT * FROM {rows} WHERE taught)", features, s.bins)]
    begun = f"(SELECT r.*, x.s FROM {rows} r JOIN {start} x ON r.query_id = x.query_id AND r.pos = x.pos)" if start else f"(SELECT *, 0::DOUBLE AS s FROM {rows})"
    out.append(f"{name}_s{first} AS MATERIALIZED (SELECT query_id, pos, label, taught, s, {bins} FROM {begun})")
    for r in range(first, first + s.rounds):
        out.append(f"{name}_n{r}_0 AS MATERIALIZED (SELECT query_id, pos, label, taught, s, {', '.join(f'b{i}' for i in k)}, g, h, 0 AS node FROM {derivatives_sql(f'{name}_s{r}')})")
        for level in range(s.depth):
            now = f"{name}_n{r}_{level}"
            cells = " UNION ALL ".join(f"SELECT node, {i} AS feature, b{i} AS bin, g, h FROM {now} WHERE taught AND node >= {2**level - 1}" for i in k)
            out.append(f"""{name}_b{r}_{level} AS MATERIALIZED (SELECT * FROM (
                SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, feature, bin, missing_low) AS place FROM (
                SELECT *, {bo.gain_sql(s.lam)} AS gain FROM (
                SELECT node, feature, bin, missing_low, g, h, lg + CASE WHEN missing_low THEN mg ELSE 0 END AS lg, lh + CASE WHEN missing_low THEN mh ELSE 0 END AS lh FROM (
                SELECT node, feature, bin, sum(g) OVER w AS g, sum(h) OVER w AS h, coalesce(sum(CASE WHEN bin = -1 THEN g END) OVER w, 0) AS mg, coalesce(sum(CASE WHEN bin = -1 THEN h END) OVER w, 0) AS mh,
                       coalesce(sum(CASE WHEN bin >= 0 THEN g END) OVER o, 0) AS lg, coalesce(sum(CASE WHEN bin >= 0 THEN h END) OVER o, 0) AS lh
                FROM (SELECT node, feature, bin, sum(g)::BIGINT AS g, sum(h)::BIGINT AS h FROM ({cells}) GROUP BY ALL) WINDOW w AS (PARTITION BY node, feature), o AS (PARTITION BY node, feature ORDER BY bin)), (VALUES (FALSE), (TRUE)) m(missing_low) WHERE bin >= 0)
                WHERE lh >= {least} AND h - lh >= {least}) WHERE gain > 0) WHERE place = 1)""")
            own = "CASE b.feature " + " ".join(f"WHEN {i} THEN n.b{i}" for i in k) + " END"
            out.append(f"""{name}_n{r}_{level + 1} AS MATERIALIZED (SELECT n.* EXCLUDE (node), CASE WHEN b.node IS NULL THEN n.node WHEN CASE WHEN {own} = -1 THEN b.missing_low ELSE {own} <= b.bin END THEN 2 * n.node + 1 ELSE 2 * n.node + 2 END AS node
                FROM {now} n LEFT JOIN {name}_b{r}_{level} b ON n.node = b.node)""")
        end = f"{name}_n{r}_{s.depth}"
        out.append(f"{name}_t{r} AS MATERIALIZED ({' UNION ALL '.join(f'SELECT {r} AS tree, * FROM {name}_b{r}_{level}' for level in range(s.depth))})")
        out.append(f"{name}_v{r} AS MATERIALIZED (SELECT node, -(sum(g)::DOUBLE / {u}) / (sum(h)::DOUBLE / {u} + {s.lam}::DOUBLE) AS v FROM {end} WHERE taught GROUP BY node)")
        out.append(f"{name}_s{r + 1} AS MATERIALIZED (SELECT query_id, pos, label, taught, s + {s.rate}::DOUBLE * v AS s, {', '.join(f'b{i}' for i in k)} FROM {end} JOIN {name}_v{r} USING (node))")
    return out
