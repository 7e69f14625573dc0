"""The registered queries in DuckDB's SQL, written apart from the Spark versions."""

from __future__ import annotations

OBS = """lo AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_suppkey, l_linenumber, l_extendedprice, l_shipdate) AS k FROM lineitem),
obs AS (SELECT l_partkey * 10 + k AS rid, l_partkey AS id, p_name AS name, p_brand AS brand, p_type AS category, n_name AS locality,
  CAST(-122.0 AS DOUBLE) + CAST(l_partkey % 500 AS DOUBLE) * CAST(0.0001 AS DOUBLE) + CAST(l_orderkey % 7 AS DOUBLE) * CAST(0.00001 AS DOUBLE) AS lon,
  CAST(37.0 AS DOUBLE) + CAST(l_partkey % 40 AS DOUBLE) * CAST(0.0001 AS DOUBLE) + CAST(l_linenumber AS DOUBLE) * CAST(0.00001 AS DOUBLE) AS lat
  FROM lo JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE k <= 2 + l_partkey % 4)"""
DIST = ("(CAST(12742017.6 AS DOUBLE) * asin(sqrt(least(CAST(1 AS DOUBLE), greatest(CAST(0 AS DOUBLE), pow(sin(radians(b.lat - a.lat) / 2), 2) "
        "+ cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))))")
CM = "CAST(round(d * 100) AS BIGINT) AS distance_cm"
NEAR = f"""belt AS (SELECT *, CAST(floor(lat / CAST(0.0001 AS DOUBLE)) AS BIGINT) AS belt FROM obs),
beside AS (SELECT belt.* REPLACE (belt + d AS belt) FROM belt, (VALUES (-1), (0), (1)) t(d)),
near AS (SELECT * FROM (SELECT a.rid AS rid_a, b.rid AS rid_b, a.id AS id_a, b.id AS id_b, {DIST} AS d, coalesce(a.category = b.category, false) AS preferred, a.lat AS lat_a, a.lon AS lon_a
  FROM belt a JOIN beside b ON a.belt = b.belt AND a.rid < b.rid AND a.id <> b.id AND abs(a.lat - b.lat) < 0.0001) WHERE d < 10)"""
_KEYED = "nm AS (SELECT obs.*, lower(regexp_replace(obs.name, '^\\s+|\\s+$', '', 'g')) AS name_key FROM obs)"
_SAME = f"""same AS (SELECT * FROM (SELECT a.rid AS rid_a, b.rid AS rid_b, a.id AS id_a, b.id AS id_b, {DIST} AS d, coalesce(lower(a.locality) = lower(b.locality) AND a.locality <> '', false) AS preferred, a.name_key AS name_key
  FROM kept a JOIN kept b ON a.name_key = b.name_key AND a.rid < b.rid AND a.id <> b.id) WHERE d >= 200 AND d <= 50000)"""
NAMED = f"""{_KEYED}, kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name_key ORDER BY md5('rows|' || rid), rid) AS rn FROM nm WHERE name_key <> '') WHERE rn <= 500),
{_SAME}"""
ALL_NAMED = f"{_KEYED}, kept AS (SELECT * FROM nm WHERE name_key <> ''), {_SAME}"
CAPPED = "capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name_key ORDER BY preferred DESC, md5('group|' || rid_a || '|' || rid_b), rid_a, rid_b) AS n FROM same) WHERE n <= 5)"
CLOSEST = f"""pairs AS (SELECT a.id AS id, a.rid AS rid_a, b.rid AS rid_b, {DIST} AS d FROM obs a JOIN obs b ON a.id = b.id AND a.rid < b.rid),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, rid_a, rid_b) AS n FROM pairs) WHERE n = 1 AND d < 5)"""

PLACE_ROW_COUNTS = f"WITH {OBS} SELECT id, count(*) AS n FROM obs GROUP BY id"
PLACE_MIN_ROWS_GUARD = f"WITH {OBS}, c AS (SELECT id, count(*) AS n FROM obs GROUP BY id) SELECT min(n) AS fewest, max(n) AS most, count(*) FILTER (n < 2) AS too_few FROM c"
LARGEST_GROUPS = f"WITH {OBS}, c AS (SELECT id, count(*) AS n FROM obs GROUP BY id) SELECT n, count(*) AS places, CAST(row_number() OVER (ORDER BY n DESC) AS INTEGER) AS place_rank FROM c GROUP BY n"
CLOSEST_PAIR_PER_PLACE = f"WITH {OBS}, {CLOSEST} SELECT id, rid_a, rid_b, {CM} FROM best"
#: The rows of a join as they are: CTEs are materialised, so that no filter is moved into the join.
_KEPT = (f"WITH {OBS}, {NEAR}".replace("obs AS (", "obs AS MATERIALIZED (").replace("belt AS (", "belt AS MATERIALIZED (", 1).replace("beside AS (", "beside AS MATERIALIZED (").replace("near AS (", "near AS MATERIALIZED ("))
GEO_HARD_CANDIDATES = f"{_KEPT} SELECT rid_a, rid_b, {CM}, preferred FROM near ORDER BY rid_a, rid_b"
_H = "(degrees(CAST(10 AS DOUBLE) / CAST(6371008.8 AS DOUBLE)) * CAST(1.001 AS DOUBLE))"
GEO_CELL_CAPPED = f"""WITH {OBS}, {NEAR}, b AS (SELECT *, CAST(floor(lat_a / {_H}) AS BIGINT) AS band FROM near),
n AS (SELECT *, greatest(1, CAST(floor(CAST(360 AS DOUBLE) * cos(radians(least(greatest(abs(band * {_H}), abs((band + 1) * {_H})), CAST(90 AS DOUBLE)))) / {_H} / CAST(1.001 AS DOUBLE)) AS BIGINT)) AS cells FROM b),
c AS (SELECT *, ((CAST(floor((lon_a + CAST(180 AS DOUBLE)) / CAST(360 AS DOUBLE) * cells) AS BIGINT) % cells) + cells) % cells AS cx FROM n),
r AS (SELECT *, row_number() OVER (PARTITION BY band, cx ORDER BY preferred DESC, md5('cell|' || rid_a || '|' || rid_b), rid_a, rid_b) AS k FROM c)
SELECT rid_a, rid_b, {CM}, preferred, band, cx FROM r WHERE k <= 5"""
BRAND_HARD_CANDIDATES = (f"WITH {OBS}, {ALL_NAMED}".replace("obs AS (", "obs AS MATERIALIZED (").replace("kept AS (", "kept AS MATERIALIZED (").replace("same AS (", "same AS MATERIALIZED (")
                         + f" SELECT rid_a, rid_b, {CM}, preferred FROM same ORDER BY rid_a, rid_b")
BRAND_GROUP_CAPPED = f"WITH {OBS}, {NAMED}, {CAPPED} SELECT rid_a, rid_b, {CM}, preferred, name_key FROM capped"
NAME_BLOCKS_CAPPED = f"WITH {OBS}, {ALL_NAMED}, {CAPPED} SELECT rid_a, rid_b, {CM}, preferred, name_key FROM capped"
DENSEST_FIRST_CAP = f"""WITH {OBS}, {NAMED}, {CAPPED}, u AS (SELECT name_key, count(*) AS pairs FROM capped GROUP BY name_key), de AS (SELECT name_key, count(*) AS density FROM nm GROUP BY name_key),
o AS (SELECT u.name_key, coalesce(sum(pairs) OVER (ORDER BY density DESC, u.name_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM u JOIN de ON u.name_key = de.name_key)
SELECT rid_a, rid_b, {CM}, name_key FROM capped WHERE name_key IN (SELECT name_key FROM o WHERE before < 40)"""
_FREE = "NOT (list_contains(used, p.id_a) OR list_contains(used, p.id_b))"
GREEDY_HARD_NEGATIVES = f"""WITH RECURSIVE {OBS}, {NAMED}, {CAPPED},
pool AS MATERIALIZED (SELECT rid_a, rid_b, id_a, id_b, preferred, d, row_number() OVER (ORDER BY preferred DESC, md5('greedy|' || rid_a || '|' || rid_b), rid_a, rid_b) AS i FROM capped),
walk(step, used, taken) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[])
  UNION ALL SELECT p.i, CASE WHEN {_FREE} THEN list_concat(used, [p.id_a, p.id_b]) ELSE used END, CASE WHEN {_FREE} THEN list_append(taken, p.i) ELSE taken END
  FROM walk JOIN pool p ON p.i = step + 1 WHERE len(taken) < 100),
won AS (SELECT unnest(taken) AS i FROM (SELECT taken FROM walk ORDER BY step DESC LIMIT 1))
SELECT rid_a, rid_b, {CM}, id_a, id_b, preferred FROM pool JOIN won USING (i)"""
_OWN = "row_number() OVER (PARTITION BY id ORDER BY md5('{0}|' || rid), rid)"


def _far(r: int, seed: str, unused: str, n: str) -> str:
    """f<r>: one round of far pairs of n places of a relation unused(id)."""
    at = f"{seed}/{r}"
    return f"""r{r} AS MATERIALIZED (SELECT id, k FROM (SELECT id, row_number() OVER (ORDER BY md5('{at}|' || id), id) - 1 AS k FROM {unused}) WHERE k < {n}),
o{r} AS MATERIALIZED (SELECT * FROM (SELECT obs.*, {_OWN.format(at)} AS n FROM obs WHERE id IN (SELECT id FROM r{r})) WHERE n = 1),
f{r} AS MATERIALIZED (SELECT * FROM (SELECT a.rid AS rid_a, b.rid AS rid_b, a.id AS id_a, b.id AS id_b, {DIST} AS d, a.category IS DISTINCT FROM b.category AS preferred
  FROM r{r} p JOIN r{r} q ON p.k % 2 = 0 AND q.k = p.k + 1 JOIN o{r} a ON a.id = p.id JOIN o{r} b ON b.id = q.id) WHERE d >= 1000)"""


def _easy(seed: str, unused: str, k: str, rounds: int) -> str:
    """easy: k far pairs of different categories in at most that many rounds; the operator's later rounds, by distance only, are left out."""
    parts = ["t0 AS (SELECT CAST(NULL AS BIGINT) AS rid_a, CAST(NULL AS BIGINT) AS rid_b, CAST(NULL AS BIGINT) AS id_a, CAST(NULL AS BIGINT) AS id_b, CAST(NULL AS DOUBLE) AS d, true AS preferred WHERE false)"]
    for r in range(rounds):
        parts.append(f"u{r} AS MATERIALIZED (SELECT id FROM {unused} WHERE id NOT IN (SELECT unnest([id_a, id_b]) FROM t{r}))")
        parts.append(_far(r, seed, f"u{r}", f"8 * ({k} - (SELECT count(*) FROM t{r}))"))
        parts.append(f"""g{r} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY md5('{seed}|' || rid_a || '|' || rid_b), rid_a) AS n FROM f{r} WHERE preferred) WHERE n <= {k} - (SELECT count(*) FROM t{r})),
t{r + 1} AS MATERIALIZED (SELECT * FROM t{r} UNION ALL SELECT rid_a, rid_b, id_a, id_b, d, preferred FROM g{r})""")
    return ", ".join([*parts, f"easy AS (SELECT * FROM t{rounds})"])


def _greedy(name: str, pool: str, seed: str, k: str) -> str:
    """<name>: the pairs that a walk over a pool takes, k at most, one step of the recursion per pair."""
    return f"""{name}_pool AS MATERIALIZED (SELECT rid_a, rid_b, id_a, id_b, preferred, d, row_number() OVER (ORDER BY preferred DESC, md5('{seed}|' || rid_a || '|' || rid_b), rid_a, rid_b) AS i FROM {pool}),
{name}_walk(step, used, taken) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[])
  UNION ALL SELECT p.i, CASE WHEN {_FREE} THEN list_concat(used, [p.id_a, p.id_b]) ELSE used END, CASE WHEN {_FREE} THEN list_append(taken, p.i) ELSE taken END
  FROM {name}_walk JOIN {name}_pool p ON p.i = step + 1 WHERE len(taken) < {k}),
{name} AS MATERIALIZED (SELECT * FROM {name}_pool WHERE i IN (SELECT unnest(taken) FROM (SELECT taken FROM {name}_walk ORDER BY step DESC LIMIT 1)))"""


def _of(part: str) -> str:
    return f"(SELECT {part} FROM want)"


_NAMED_0 = NAMED.replace("'rows|'", "'0|'") + ", " + CAPPED.replace("'group|'", "'0|'")
_GEO_0 = f"""band AS (SELECT *, CAST(floor(lat_a / {{H}}) AS BIGINT) AS band FROM near),
cell AS (SELECT *, CAST(floor((lon_a + CAST(180 AS DOUBLE)) / CAST(360 AS DOUBLE) * greatest(1, CAST(floor(CAST(360 AS DOUBLE) * cos(radians(least(greatest(abs(band * {{H}}), abs((band + 1) * {{H}})), CAST(90 AS DOUBLE)))) / {{H}} / CAST(1.001 AS DOUBLE)) AS BIGINT))) AS BIGINT) AS cx FROM band),
close AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY band, cx ORDER BY preferred DESC, md5('0|' || rid_a || '|' || rid_b), rid_a, rid_b) AS n FROM cell) WHERE n <= 5)""".replace("{H}", _H)
#: A pair table of the smallest tier by plain walks; no cell here has so many rows, no pool so many pairs that their caps count.
_TABLE = ", ".join([
    f"WITH RECURSIVE {OBS}, {NEAR}, {_NAMED_0}, {CLOSEST}, {_GEO_0}",
    "size AS (SELECT CASE WHEN count(DISTINCT id) >= 2000 THEN 1000 ELSE 60 END AS n FROM obs)",
    "hard AS (SELECT n, n // 2 AS m, CAST(round_even((n - n // 2) * 0.4::DOUBLE, 0) AS BIGINT) AS hard FROM size)",
    "want AS MATERIALIZED (SELECT n, m, hard - CAST(round_even(hard * 0.5::DOUBLE, 0) AS BIGINT) AS geo, CAST(round_even(hard * 0.5::DOUBLE, 0) AS BIGINT) AS brand, n - m - hard AS easy FROM hard)",
    f"m AS MATERIALIZED (SELECT id, rid_a, rid_b, d FROM (SELECT id, rid_a, rid_b, d, row_number() OVER (ORDER BY md5('42|' || id), id) AS k FROM best) WHERE k <= {_of('m')})",
    "for_geo AS MATERIALIZED (SELECT * FROM close WHERE id_a NOT IN (SELECT id FROM m) AND id_b NOT IN (SELECT id FROM m))", _greedy("geo", "for_geo", "42/geo", _of("geo")),
    "gone AS MATERIALIZED (SELECT id FROM m UNION SELECT unnest([id_a, id_b]) FROM geo)",
    "for_brand AS MATERIALIZED (SELECT * FROM capped WHERE id_a NOT IN (SELECT id FROM gone) AND id_b NOT IN (SELECT id FROM gone))", _greedy("brand", "for_brand", "42/brand", _of("brand")),
    "free AS MATERIALIZED (SELECT DISTINCT id FROM obs WHERE id NOT IN (SELECT id FROM gone) AND id NOT IN (SELECT unnest([id_a, id_b]) FROM brand))", _easy("42/easy", "free", _of("easy"), 20),
    """made AS (SELECT 1 AS label, 'match' AS pair_type, '' AS hard_neg_source, d, true AS preferred, rid_a, rid_b FROM m
  UNION ALL SELECT 0, 'hard_negative', 'geo', d, preferred, rid_a, rid_b FROM geo UNION ALL SELECT 0, 'hard_negative', 'brand', d, preferred, rid_a, rid_b FROM brand
  UNION ALL SELECT 0, 'easy_negative', '', d, preferred, rid_a, rid_b FROM easy)""",
    """sided AS MATERIALIZED (SELECT row_number() OVER (ORDER BY md5('42/order|' || rid_a || '|' || rid_b), rid_a, rid_b) - 1 AS pair_id, label, pair_type, hard_neg_source, d, preferred,
  CASE WHEN substr(md5('42/side|' || rid_a || '|' || rid_b), 1, 1) < '8' THEN rid_b ELSE rid_a END AS l, CASE WHEN substr(md5('42/side|' || rid_a || '|' || rid_b), 1, 1) < '8' THEN rid_a ELSE rid_b END AS r FROM made)""",
    "tab AS MATERIALIZED (SELECT sided.*, x.id AS left_id, y.id AS right_id, x.category AS left_category, y.category AS right_category, lower(x.locality) AS left_locality, lower(y.locality) AS right_locality FROM sided JOIN obs x ON x.rid = l JOIN obs y ON y.rid = r)"])
EASY_NEGATIVES = f"WITH {OBS}, places AS (SELECT DISTINCT id FROM obs), {_easy('easy', 'places', '30', 20)} SELECT rid_a, rid_b, {CM}, id_a, id_b, preferred FROM easy"
GEO_PAIRS = f"{_TABLE} SELECT pair_id, label, pair_type, hard_neg_source, {CM}, preferred, l AS left_rid, r AS right_rid, left_id, right_id, left_category, right_category, left_locality, right_locality FROM tab"
REVIEW_BRAND = f"{_TABLE} SELECT pair_id, pair_type, hard_neg_source, l AS left_rid, r AS right_rid FROM tab WHERE hard_neg_source = 'brand'"
PAIR_TYPE_BREAKDOWN = f"{_TABLE} SELECT pair_type, count(*) AS n FROM tab GROUP BY pair_type"
GEO_PAIR_STATS = f"""{_TABLE} SELECT count(*) AS pairs, count(*) FILTER (label = 1) AS matches, count(*) FILTER (label = 0) AS non_matches, count(*) FILTER (hard_neg_source = 'geo') AS hard_geo,
  count(*) FILTER (hard_neg_source = 'geo' AND preferred) AS hard_geo_same_category, count(*) FILTER (hard_neg_source = 'brand') AS hard_brand, count(*) FILTER (hard_neg_source = 'brand' AND preferred) AS hard_brand_same_locality,
  count(*) FILTER (pair_type = 'easy_negative') AS easy, 2 * count(*) AS rows_used, 5::DOUBLE AS match_m, 10::DOUBLE AS geo_m, 1000::DOUBLE AS easy_m, 200::DOUBLE AS brand_min_m, 50000::DOUBLE AS brand_max_m,
  0.4::DOUBLE AS hard_fraction, 0.5::DOUBLE AS brand_fraction, 42::INTEGER AS seed FROM tab"""
GEO_PAIR_INVARIANTS = f"""{_TABLE} SELECT abs(count(*) - {_of('n')}) AS wrong_count, abs(count(*) FILTER (pair_type = 'match') - {_of('m')}) AS wrong_matches, abs(count(*) FILTER (hard_neg_source = 'geo') - {_of('geo')}) AS wrong_geo,
  abs(count(*) FILTER (hard_neg_source = 'brand') - {_of('brand')}) AS wrong_brand, abs(count(*) FILTER (pair_type = 'easy_negative') - {_of('easy')}) AS wrong_easy, count(*) FILTER (pair_type = 'match' AND left_id <> right_id) AS match_of_two_ids,
  count(*) FILTER (label = 0 AND left_id = right_id) AS negative_of_one_id, count(*) FILTER ((label = 1) <> (pair_type = 'match')) AS label_against_type, count(*) FILTER ((hard_neg_source <> '') <> (pair_type = 'hard_negative')) AS source_against_type,
  count(*) FILTER (pair_type = 'match' AND d >= 5) AS match_too_far, count(*) FILTER (hard_neg_source = 'geo' AND d >= 10) AS geo_too_far, count(*) FILTER (hard_neg_source = 'brand' AND d < 200) AS brand_too_near,
  count(*) FILTER (hard_neg_source = 'brand' AND d > 50000) AS brand_too_far, count(*) FILTER (pair_type = 'easy_negative' AND d < 1000) AS easy_too_near, count(*) FILTER (l = r) AS same_row_twice,
  abs(max(pair_id) - min(pair_id) + 1 - count(DISTINCT pair_id)) AS pair_id_gaps, (SELECT count(*) - count(DISTINCT x) FROM (SELECT unnest([l, r]) AS x FROM sided)) AS rows_used_twice FROM tab"""
ALIGNMENT_SPOTCHECK = """WITH i AS (SELECT row_number() OVER () - 1 AS row_index, l_orderkey, l_linenumber, l_extendedprice FROM lineitem)
SELECT row_index, l_orderkey, l_linenumber, l_extendedprice, l_orderkey AS l_orderkey_again, l_linenumber AS l_linenumber_again, l_extendedprice AS l_extendedprice_again, true AS same
FROM i ORDER BY md5('spot|' || row_index), row_index LIMIT 50"""
_LINE = "CASE WHEN length({0}) > 12 THEN substr({0}, 1, 11) || '…' ELSE {0} END"
NESTED_PREVIEW = f"""SELECT p_partkey, {_LINE.format("CASE WHEN p_partkey % 2 = 1 THEN p_name ELSE p_type END")} AS names,
  CASE WHEN p_partkey % 3 = 0 THEN '-' ELSE {_LINE.format("p_type")} END AS addresses, {_LINE.format("CASE WHEN p_partkey % 2 = 1 THEN p_name ELSE p_brand END")} AS tags FROM part"""
BRAND_OR_NAME_KEY = "SELECT p_partkey, lower(trim(CASE WHEN p_partkey % 3 = 1 THEN p_brand ELSE p_name END)) AS name_key FROM part"
LOCALITY_KEY = "SELECT s_suppkey, CASE WHEN s_suppkey % 4 IN (0, 1) THEN '' ELSE lower(trim(n_name)) END AS locality FROM supplier JOIN nation ON s_nationkey = n_nationkey"
WKB_POINT_DECODE = f"WITH {OBS} SELECT rid, lon, lat FROM obs"
NAIVE_PLACE_DRAW = f"""WITH {OBS}, r AS (SELECT id, row_number() OVER (ORDER BY md5('naive|' || id), id) - 1 AS k FROM (SELECT DISTINCT id FROM obs)),
t AS (SELECT * FROM r WHERE k < 100) SELECT a.k // 2 AS pair, a.id AS id_a, b.id AS id_b FROM t a JOIN t b ON a.k % 2 = 0 AND b.k = a.k + 1"""
NAIVE_PAIRS_WIDE = f"""WITH {OBS}, ids AS (SELECT id, row_number() OVER (ORDER BY md5('naive|' || id), id) - 1 AS k FROM (SELECT DISTINCT id FROM obs)),
p AS (SELECT * FROM ids WHERE k < 150), w AS (SELECT obs.rid, p.k, row_number() OVER (PARTITION BY obs.id ORDER BY md5('naive|' || rid), rid) AS n FROM obs JOIN p ON obs.id = p.id),
u AS (SELECT 1 AS label, a.rid AS rid_a, b.rid AS rid_b FROM w a JOIN w b ON a.k = b.k AND a.n = 1 AND b.n = 2 WHERE a.k < 50
  UNION ALL SELECT 0, a.rid, b.rid FROM w a JOIN w b ON b.k = a.k + 1 AND a.n = 1 AND b.n = 1 WHERE a.k >= 50 AND (a.k - 50) % 2 = 0),
f AS (SELECT label, row_number() OVER (ORDER BY md5('naive/order|' || rid_a || '|' || rid_b), rid_a, rid_b) - 1 AS pair_id, substr(md5('naive/side|' || rid_a || '|' || rid_b), 1, 1) < '8' AS flip, rid_a, rid_b FROM u),
s AS (SELECT pair_id, label, CASE WHEN flip THEN rid_b ELSE rid_a END AS l, CASE WHEN flip THEN rid_a ELSE rid_b END AS r FROM f)
SELECT pair_id, label, x.rid AS left_rid, y.rid AS right_rid, x.id AS left_id, y.id AS right_id, x.name AS left_name, y.name AS right_name FROM s JOIN obs x ON x.rid = l JOIN obs y ON y.rid = r"""
PAIR_BUDGETS = """WITH p AS (SELECT coalesce(p_brand, 'all') AS brand_name, count(*) AS pairs FROM part GROUP BY ROLLUP (p_brand)),
h AS (SELECT *, pairs // 2 AS m, CAST(round_even((pairs - pairs // 2) * 0.4::DOUBLE, 0) AS BIGINT) AS hard FROM p),
b AS (SELECT *, CAST(round_even(hard * 0.5::DOUBLE, 0) AS BIGINT) AS brand FROM h)
SELECT brand_name, pairs, m AS match, hard - brand AS geo, brand, pairs - m - hard AS easy FROM b"""
WIDEN_BY_PLACE = """WITH i AS (SELECT row_number() OVER () - 1 AS rid, l_orderkey, l_linenumber, l_extendedprice FROM lineitem),
p AS (SELECT k AS pair_id FROM (SELECT unnest(range((SELECT count(*) FROM lineitem) // 2)) AS k) ORDER BY md5('fetch|' || k), k LIMIT 40)
SELECT pair_id, a.rid AS left_rid, b.rid AS right_rid, a.l_orderkey AS left_l_orderkey, b.l_orderkey AS right_l_orderkey, a.l_linenumber AS left_l_linenumber, b.l_linenumber AS right_l_linenumber,
  a.l_extendedprice AS left_l_extendedprice, b.l_extendedprice AS right_l_extendedprice FROM p JOIN i a ON a.rid = 2 * pair_id JOIN i b ON b.rid = 2 * pair_id + 1"""
FETCH_BY_KEY = """WITH o AS (SELECT o_orderkey FROM orders ORDER BY md5('fetch|' || o_orderkey), o_orderkey LIMIT 50)
SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o)"""
_CARD = "printf('  %-14s %-70s | %s', '{0}', {1}, {2})"
_ONE = "CASE WHEN length({0}) > 70 THEN substr({0}, 1, 69) || '…' ELSE {0} END"
PAIR_CARDS = f"""{NAIVE_PAIRS_WIDE.replace("SELECT pair_id, label, x.rid", ", wide AS (SELECT pair_id, label, x.rid")})
SELECT pair_id, printf('pair %d', pair_id) || '  label ' || label || chr(10) || {_CARD.format("rid", "CAST(left_rid AS VARCHAR)", "CAST(right_rid AS VARCHAR)")} || chr(10) || {_CARD.format("id", "CAST(left_id AS VARCHAR)", "CAST(right_id AS VARCHAR)")}
  || chr(10) || {_CARD.format("name", _ONE.format("left_name"), _ONE.format("right_name"))} AS card
FROM wide ORDER BY md5('cards|' || pair_id), pair_id LIMIT 12"""
MATCH_DRAW = f"WITH {OBS}, {CLOSEST} SELECT id, rid_a, rid_b, {CM} FROM best ORDER BY md5('draw|' || id), id LIMIT 100"
FAR_ROUND = f"""WITH {OBS}, r AS (SELECT id, row_number() OVER (ORDER BY md5('far|' || id), id) - 1 AS k FROM (SELECT DISTINCT id FROM obs)), t AS (SELECT * FROM r WHERE k < 200),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY md5('far|' || rid), rid) AS n FROM obs) WHERE n = 1),
x AS (SELECT a.rid AS rid_a, b.rid AS rid_b, a.id AS id_a, b.id AS id_b, {DIST} AS d, a.category IS DISTINCT FROM b.category AS preferred
  FROM t p JOIN t q ON p.k % 2 = 0 AND q.k = p.k + 1 JOIN o a ON a.id = p.id JOIN o b ON b.id = q.id)
SELECT rid_a, rid_b, {CM}, id_a, id_b, preferred FROM x WHERE d >= 1000"""
EX = """ex AS (SELECT l.doc_id AS row_index, 'row_' || CASE WHEN l.doc_id < 1000000 THEN lpad(CAST(l.doc_id AS VARCHAR), 6, '0') ELSE CAST(l.doc_id AS VARCHAR) END AS example_id,
  CASE quality WHEN 1 THEN 'MATCH' ELSE 'NO_MATCH' END AS label, text, source FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""
_SHOWN = "CASE WHEN trim({0}, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)) = '' OR {0} IS NULL THEN 'null' ELSE CAST(to_json(trim({0}, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160))) AS VARCHAR) END"


def _prompts(template: str, last: str) -> str:
    """The prompt of every example: records of names and lang, and what follows them."""
    record = lambda c: "'{\"names\": ' || " + _SHOWN.format(c) + " || ', \"lang\": ' || " + _SHOWN.format("lang") + f" || '{last}}}'"
    before, between, after = (x.replace("'", "''") for x in template.replace("{record_b}", "{record_a}").split("{record_a}"))
    return f"""{EX.replace("text, source FROM", "text, source, lang FROM")}, pr AS (SELECT *, '{before}' || {record("text")} || '{between}' || {record("source")} || '{after}' AS prompt FROM ex)"""


def prompt_render(template: str) -> str:
    return f"""WITH {_prompts(template, ', "phones": null')} SELECT example_id, prompt FROM pr"""


def score_hash(template: str) -> str:
    odd = "('0x' || substr(md5(prompt), 1, 2))::INTEGER % 2 = 1"
    return f"""WITH {_prompts(template, '')} SELECT example_id, label AS ground_truth, CASE WHEN {odd} THEN 'MATCH' ELSE 'no match.' END AS raw_model_output, CAST(0.01 AS DOUBLE) AS latency_seconds,
  CAST(len(regexp_extract_all(prompt, '[^\\s]+')) AS BIGINT) AS input_tokens, CAST(2 AS BIGINT) AS output_tokens, CAST(NULL AS VARCHAR) AS request_error, row_index,
  CASE WHEN {odd} THEN 'MATCH' ELSE 'NO_MATCH' END AS prediction, true AS valid_prediction, 'hash' AS model, 'p' AS prompt_name, '1' AS prompt_version FROM pr"""


BALANCED_LIMIT = f"""WITH {EX}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY row_index) AS n FROM ex)
SELECT row_index, example_id, label FROM r WHERE n <= CASE label WHEN 'MATCH' THEN 26 ELSE 25 END"""
EXAMPLE_NORMALISE = f"WITH {EX} SELECT row_index, example_id, label, text AS a_names, source AS b_names, row_index AS doc_id FROM ex"
DATASET_MANIFEST = "SELECT count(*) FILTER (quality = 1) AS matches, count(*) FILTER (quality = 0) AS non_matches, count(*) AS total FROM labels"
_ANS = """VALUES ('MATCH'), ('match.'), ('"NO_MATCH"'), ('Answer: no match'), ('`NO-MATCH`'), ('Probably MATCH'), ('MATCH or NO_MATCH'), ('{"prediction":"MATCH"}'), ('YES'), (''), (NULL), ('NOMATCH'), ('NO  MATCH'), ('MATCH!.'), (' ''no_match'' '), ('answer :MATCH !')"""
_LBL = """upper(regexp_extract(trim(regexp_replace(trim(coalesce(raw, '')), '^[`"'']+|[`"'']+$', '', 'g')), '^(?:(?i)answer\\s*:\\s*)?((?i)no[\\s_-]?match|match)\\s*[.!]?\\s*$', 1))"""
_LIST = "[" + _ANS.removeprefix("VALUES ").replace("(NULL)", "NULL").replace("('", "'").replace("')", "'") + "]"
LABEL_PARSE_EACH = f"""WITH a AS (SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 4 = 3 THEN text ELSE ({_LIST})[(conv_id * 7 + turn) % 16 + 1] END AS raw FROM conversations),
l AS (SELECT conv_id, turn, regexp_replace({_LBL}, '[\\s-]', '_', 'g') AS s FROM a)
SELECT conv_id, turn, CASE WHEN s = '' THEN 'INVALID' WHEN s IN ('NO_MATCH', 'NOMATCH') THEN 'NO_MATCH' ELSE 'MATCH' END AS prediction, CASE WHEN s = '' THEN 'INVALID' WHEN s = 'NO_MATCH' THEN 'NO_MATCH' ELSE 'MATCH' END AS strict FROM l"""
LABEL_PARSE = f"""WITH a AS (SELECT * FROM ({_ANS}) t(raw) UNION ALL SELECT text FROM conversations), l AS (SELECT regexp_replace({_LBL}, '[\\s-]', '_', 'g') AS s FROM a)
SELECT CASE WHEN s = '' THEN 'INVALID' WHEN s IN ('NO_MATCH', 'NOMATCH') THEN 'NO_MATCH' ELSE 'MATCH' END AS prediction, count(*) AS n FROM l GROUP BY 1"""
CONFUSION_METRICS = """WITH x AS (SELECT quality = 1 AS t, CASE WHEN doc_id % 11 = 0 THEN 'I' WHEN toxic = 1 THEN 'M' ELSE 'N' END AS p FROM labels),
c AS (SELECT count(*) AS total_examples, count(*) FILTER (t AND p = 'M') AS true_positives, count(*) FILTER (NOT t AND p = 'N') AS true_negatives,
  count(*) FILTER (NOT t AND p <> 'N') AS false_positives, count(*) FILTER (t AND p <> 'M') AS false_negatives, count(*) FILTER (p = 'I') AS invalid_count, CAST(0 AS BIGINT) AS request_error_count FROM x),
s AS (SELECT *, (true_positives + true_negatives) / total_examples AS accuracy, coalesce(true_positives / nullif(true_positives + false_positives, 0), 0) AS precision,
  coalesce(true_positives / nullif(true_positives + false_negatives, 0), 0) AS recall, invalid_count / total_examples AS invalid_rate FROM c)
SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM s"""
LATENCY_QUANTILES = "SELECT round(avg(value), 6) AS average_latency_seconds, round(median(value), 6) AS median_latency_seconds, round(quantile_cont(value, 0.95), 6) AS p95_latency_seconds FROM events"
TOKEN_TOTALS = """WITH x AS (SELECT CAST(sum(length(text)) AS BIGINT) AS i, CAST(sum(length(role)) AS BIGINT) AS o, count(*) AS n, count(*) FILTER (text IS NULL OR role IS NULL) > 0 AS lost FROM conversations)
SELECT CASE WHEN NOT lost THEN i END AS total_input_tokens, CASE WHEN NOT lost THEN o END AS total_output_tokens, CASE WHEN NOT lost THEN i + o END AS total_tokens,
  n / 8.0::DOUBLE AS examples_per_second, CASE WHEN NOT lost THEN (i + o) / 8.0::DOUBLE END AS tokens_per_second FROM x"""
RESUME_REMAINING = f"WITH {EX} SELECT row_index, example_id, label FROM (SELECT *, row_number() OVER (ORDER BY row_index) AS n FROM ex) WHERE n > 20"
CONTENT_HASH = "SELECT doc_id, sha256(text) AS sha256 FROM documents"
FLATTEN_PREVIEW = """SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN '-' WHEN length(text) > 70 THEN substr(text, 1, 69) || '…' ELSE text END AS line
FROM documents ORDER BY md5('view|' || doc_id), doc_id LIMIT 20"""
