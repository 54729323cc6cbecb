"""Queries over the test tables, one or more for each operator, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import degree_weight
from ..operators.closure import closure, klinker, relklinker
from ..operators.dictionary import encode_triples
from ..operators.flow import edge_flows, stream
from ..operators.measures import katz, path_entropy, simrank
from ..operators.neighborhood import KEYS, adamic_adar, degree_product, jaccard, with_ids
from ..operators.relations import cooccurrence, idf_report, relation_idf, relational_similarity, top_similar
from ..operators.walks import first_features, path_features, path_totals, walk_counts, walks
from . import starschema as star
from .learn import first_sightings, frequent_paths, mutual_information, path_probabilities, predict, train_pra, train_predpath
from .methods import normalize

_NATION = star.TYPES["nation"] * 1_000_000_000
_CUSTOMER = star.TYPES["customer"] * 1_000_000_000
_TOP = 100  # fixed value: how many frequent paths count


def _six(c: str | Column) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def _scores(df: DataFrame) -> DataFrame:
    return df.select(*KEYS, _six("score").alias("score"))


def _setup(spark: SparkSession, sf_dir: str):
    return star.graph(spark, sf_dir), star.candidates(spark, sf_dir)


def _relsim(g, scheme: str = "log-tf") -> DataFrame:
    return relational_similarity(cooccurrence(g), len(star.RELATIONS), scheme)


def kg_edges(spark, d):
    return star.graph(spark, d, keep=False).edges.select("s", "p", "o")


def kg_directed_edges(spark, d):
    return star.graph(spark, d, symmetric=False, keep=False).edges.select("s", "p", "o")


def kg_degree(spark, d):
    return star.graph(spark, d, keep=False).degrees()


def kg_out_degree(spark, d):
    return star.graph(spark, d, keep=False).out_degrees()


def kg_relation_histogram(spark, d):
    return star.graph(spark, d, keep=False).relation_histogram()


def kg_dictionary_encode(spark, d):
    return encode_triples(star.named_triples(spark, d))[2]


def kg_dictionary_nodes(spark, d):
    return encode_triples(star.named_triples(spark, d))[0]


def kg_slice(spark, d):
    return star.graph(spark, d, keep=False).relation(1).select("s", "o")


def kg_neighbors(spark, d):
    return star.graph(spark, d, keep=False).neighbors(_NATION + 3)


def kg_objects(spark, d):
    return star.graph(spark, d, keep=False).objects(_CUSTOMER + 1, 3)


def kg_outgoing_relations(spark, d):
    return star.graph(spark, d, keep=False).outgoing_relations(_CUSTOMER + 1)


def kg_edge_weights(spark, d):
    g = star.graph(spark, d)
    rows = g.edges.join(g.degrees(), F.col("o") == F.col("node"))
    return rows.select("s", "p", "o", *[_six(degree_weight(F.col("d"), kind)).alias(kind) for kind in ("logdegree", "degree")])


def kg_without_candidates(spark, d):
    g, c = _setup(spark, d)
    return g.without(c.select(F.col("sid").alias("s"), F.col("pid").alias("p"), F.col("oid").alias("o"))).degrees()


def kg_update(spark, d):
    g = star.graph(spark, d, keep=False)
    new = g.relation(0).select("s", F.lit(0).alias("p"), "o", F.lit(0.5).alias("w"))
    return g.updated(new).edges.groupBy("p", "w").agg(F.count(F.lit(1)).alias("n"))


def lp_jaccard(spark, d):
    g, c = _setup(spark, d)
    return normalize(jaccard(g, c)).select(*KEYS, "class", _six("score").alias("score"), _six("softmaxscore").alias("softmaxscore"))


def lp_jaccard_effective(spark, d):
    return _scores(jaccard(*_setup(spark, d), removal="effective"))


def lp_adamic_adar(spark, d):
    return _scores(adamic_adar(*_setup(spark, d)))


def lp_degree_product(spark, d):
    return _scores(degree_product(*_setup(spark, d)))


def lp_katz(spark, d):
    return _scores(katz(*_setup(spark, d)))


def lp_katz_effective(spark, d):
    return _scores(katz(*_setup(spark, d), removal="effective"))


def lp_pathent(spark, d):
    return _scores(path_entropy(*_setup(spark, d)))


def lp_simrank(spark, d):
    return _scores(simrank(*_setup(spark, d)))


def walk_count(spark, d):
    g, c = _setup(spark, d)
    return walk_counts(g, with_ids(c))


def walk_features(spark, d):
    g, c = _setup(spark, d)
    return path_features(g, with_ids(c), None).select(*KEYS, F.array_join("rels", ",").alias("rels"), "n")


def walk_features_capped(spark, d):
    g, c = _setup(spark, d)
    return path_features(g, with_ids(c), 200).select(*KEYS, F.array_join("rels", ",").alias("rels"), "n")


def walk_listing(spark, d):
    g, c = _setup(spark, d)
    return walks(g, with_ids(c), 2).select(*KEYS, F.array_join("nodes", ",").alias("nodes"), F.array_join("rels", ",").alias("rels"))


def walk_listing_three(spark, d):
    """Walks of three edges from every nation to every region."""
    return walks(star.graph(spark, d), with_ids(star.region_candidates(spark, d)), 3).select(*KEYS, F.array_join("nodes", ",").alias("nodes"), F.array_join("rels", ",").alias("rels"))


def frequent_path_types(spark, d):
    g, c = _setup(spark, d)
    return frequent_paths(path_totals(g, with_ids(c)), _TOP).select(F.array_join("rels", ",").alias("rels"), "n")


def rel_cooccurrence(spark, d):
    return cooccurrence(star.graph(spark, d))


def rel_cooccurrence_directed(spark, d):
    return cooccurrence(star.graph(spark, d, symmetric=False))


def rel_idf(spark, d):
    return relation_idf(cooccurrence(star.graph(spark, d)), len(star.RELATIONS)).select("r2", "cnt", _six("idf").alias("idf"))


def rel_idf_report(spark, d):
    return idf_report(cooccurrence(star.graph(spark, d)), len(star.RELATIONS)).select("relation_id", _six("idf").alias("idf"), "cnt", "rank", _six("idf_norm").alias("idf_norm"))


def rel_similarity_logtf(spark, d):
    return _relsim(star.graph(spark, d)).select("r1", "r2", _six("sim").alias("sim"))


def rel_similarity_maxtf(spark, d):
    return _relsim(star.graph(spark, d), "max-tf").select("r1", "r2", _six("sim").alias("sim"))


def rel_top_similar(spark, d):
    return top_similar(_relsim(star.graph(spark, d)), 3, 3).select("r1", "r2", _six("sim").alias("sim"))


def closure_kl(spark, d):
    return _scores(klinker(*_setup(spark, d), paths=False))


def closure_klrel(spark, d):
    g, c = _setup(spark, d)
    return _scores(relklinker(g, c, _relsim(g), paths=False))


def closure_ultrametric(spark, d):
    g, c = _setup(spark, d)
    return _scores(closure(g, c, _relsim(g), kind="ultrametric", paths=False))


def closure_paths(spark, d):
    g, c = _setup(spark, d)
    return relklinker(g, c, _relsim(g)).select(*KEYS, _six("score").alias("score"), F.array_join("path", ",").alias("path"), F.array_join("rpath", ",").alias("rpath"))


def flow_stream(spark, d):
    g, c = _setup(spark, d)
    return normalize(stream(g, c, _relsim(g)))


def flow_edges(spark, d):
    g, c = _setup(spark, d)
    return edge_flows(stream(g, c, _relsim(g)))


def pra_path_probability(spark, d):
    g, c = _setup(spark, d)
    facts = with_ids(c)
    top = frequent_paths(path_totals(g, facts), _TOP)
    return path_probabilities(g, facts, top).select(*KEYS, F.array_join("rels", ",").alias("rels"), F.round("value", 8).alias("value"))


def predpath_mutual_information(spark, d):
    g, c = _setup(spark, d)
    labels = c.select(*KEYS, "class")
    return mutual_information(path_features(g, with_ids(c), 200), labels).select(F.array_join("rels", ",").alias("rels"), _six("mi").alias("mi"))


def predpath_first_sightings(spark, d):
    g, c = _setup(spark, d)
    return first_sightings(first_features(g, with_ids(c)), c.select(*KEYS, "class")).select(F.array_join("rels", ",").alias("rels"), "positive")


def predpath_model(spark, d):
    g, c = _setup(spark, d)
    return predict(train_predpath(g, c), g, c).select(*KEYS, "class", "score")


def pra_model(spark, d):
    g, c = _setup(spark, d)
    return predict(train_pra(g, c), g, c).select(*KEYS, "class", "score")


def softmax_normalize(spark, d):
    g, c = _setup(spark, d)
    return normalize(degree_product(g, c)).select(*KEYS, _six("softmaxscore").alias("softmaxscore"))


_FUNCTIONS = (
    kg_edges, kg_directed_edges, kg_degree, kg_out_degree, kg_relation_histogram, kg_dictionary_encode, kg_dictionary_nodes, kg_slice, kg_neighbors, kg_objects,
    kg_outgoing_relations, kg_edge_weights, kg_without_candidates, kg_update, lp_jaccard, lp_jaccard_effective, lp_adamic_adar, lp_degree_product, lp_katz,
    lp_katz_effective, lp_pathent, lp_simrank, walk_count, walk_features, walk_features_capped, walk_listing, walk_listing_three, frequent_path_types, rel_cooccurrence,
    rel_cooccurrence_directed, rel_idf, rel_idf_report, rel_similarity_logtf, rel_similarity_maxtf, rel_top_similar, closure_kl, closure_klrel,
    closure_ultrametric, closure_paths, flow_stream, flow_edges, pra_path_probability, predpath_mutual_information, predpath_first_sightings,
    predpath_model, pra_model, softmax_normalize,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

# SQL. Each query is a chain of named tables over the test tables.

_DIRECTED = """
    bought AS (SELECT DISTINCT o_custkey, l_partkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    raw AS (SELECT DISTINCT s::BIGINT AS s, p::INT AS p, o::BIGINT AS o FROM (
        SELECT 1000000000 + c_custkey AS s, 0 AS p, 5000000000 + c_nationkey AS o FROM customer
        UNION ALL SELECT 2000000000 + s_suppkey, 1, 5000000000 + s_nationkey FROM supplier
        UNION ALL SELECT 5000000000 + n_nationkey, 2, 6000000000 + n_regionkey FROM nation
        UNION ALL SELECT 1000000000 + o_custkey, 3, 4000000000 + l_partkey FROM bought
        UNION ALL SELECT 2000000000 + l_suppkey, 4, 4000000000 + l_partkey FROM lineitem
        UNION ALL SELECT 1000000000 + o_custkey, 5, 2000000000 + l_suppkey FROM bought))"""
_KG = f"""{_DIRECTED},
    e AS MATERIALIZED (SELECT s, p, o FROM raw UNION SELECT o, p, s FROM raw),
    deg AS MATERIALIZED (SELECT o AS node, count(DISTINCT s) AS d FROM e GROUP BY o),
    cand AS (SELECT 1000000000 + c_custkey AS sid, 0 AS pid, 5000000000 + n_nationkey AS oid, (c_nationkey = n_nationkey)::INT AS class
             FROM customer, nation),
    adj AS MATERIALIZED (SELECT s AS u, o AS v, count(*) AS m FROM e GROUP BY s, o)"""
_SIDES = f"""{_KG},
    fs AS (SELECT sid, pid, oid, v FROM cand JOIN adj ON u = sid),
    fo AS (SELECT DISTINCT oid, v FROM cand JOIN adj ON u = oid)"""
_SIZES = """,
    ds AS (SELECT sid, pid, oid, count(*) AS ds FROM fs GROUP BY ALL), dn AS (SELECT oid, count(*) AS dn FROM fo GROUP BY oid),
    com AS (SELECT sid, pid, oid, count(*) AS c FROM fs JOIN fo USING (oid, v) GROUP BY ALL),
    sized AS (SELECT sid, pid, oid, class, coalesce(ds, 0) AS ds, coalesce(dn, 0) AS dn, coalesce(c, 0) AS c
              FROM cand LEFT JOIN ds USING (sid, pid, oid) LEFT JOIN dn USING (oid) LEFT JOIN com USING (sid, pid, oid))"""
_WALKS = f"""{_KG},
    h1 AS (SELECT sid, pid, oid, p AS r1, o AS n1 FROM cand JOIN e ON s = sid), hb AS (SELECT DISTINCT oid, p AS rl, s AS b FROM cand JOIN e ON o = oid),
    l2 AS (SELECT sid, pid, oid, r1, n1, rl AS r2 FROM h1 JOIN hb USING (oid) WHERE n1 = b),
    t3 AS MATERIALIZED (SELECT oid, e.s AS n1, e.p AS r2, b AS n2, rl AS r3 FROM hb JOIN e ON e.o = b),
    l3 AS (SELECT sid, pid, oid, r1, n1, r2, n2, r3 FROM h1 JOIN t3 USING (oid, n1))"""
_COOC = """,
    ci AS (SELECT o AS v, p AS r1, count(*) AS ci FROM {e} GROUP BY o, p), cx AS (SELECT s AS v, p AS r2, count(*) AS co FROM {e} GROUP BY s, p),
    cooc AS (SELECT r1, r2, sum(ci * co)::BIGINT AS c FROM ci JOIN cx USING (v) GROUP BY r1, r2)"""
_SIM = """,
    idf AS (SELECT r2, count(*) AS cnt, ln(6.0 / count(*)) AS idf FROM cooc WHERE c > 0 GROUP BY r2),
    tf AS (SELECT r1 AS r, r2 AS k, {tf} * idf AS x FROM cooc JOIN idf USING (r2)),
    norms AS (SELECT r, sqrt(sum(x * x)) AS n FROM tf WHERE x <> 0 GROUP BY r),
    dots AS (SELECT a.r AS r1, b.r AS r2, sum(a.x * b.x) AS dot FROM tf a JOIN tf b USING (k) GROUP BY ALL),
    sims AS (SELECT a.r AS r1, b.r AS r2, least(1.0, coalesce(dot, 0) / (a.n * b.n)) AS sim FROM norms a CROSS JOIN norms b LEFT JOIN dots ON dots.r1 = a.r AND dots.r2 = b.r)"""
_LOG, _MAX = "ln(1 + c)", "c / max(c) OVER (PARTITION BY r2)"


def _features(cap: int | None) -> str:
    nth = "row_number() OVER (PARTITION BY sid, pid, oid ORDER BY {}) <= " + str(cap)
    q2 = "QUALIFY " + nth.format("r1 DESC, n1 DESC, r2 DESC") if cap else ""
    q3 = "QUALIFY " + nth.format("r1 DESC, n1 DESC, r2 DESC, n2 DESC, r3 DESC") if cap else ""
    return f"""{_WALKS}, feats AS MATERIALIZED (SELECT sid, pid, oid, '-1,' || r1 || ',' || r2 AS rels, count(*) AS n FROM (SELECT * FROM l2 {q2}) GROUP BY sid, pid, oid, r1, r2
        UNION ALL SELECT sid, pid, oid, '-1,' || r1 || ',' || r2 || ',' || r3, count(*) FROM (SELECT * FROM l3 {q3}) GROUP BY sid, pid, oid, r1, r2, r3)"""


def _closure_sql(relsim: bool, ultra: bool, paths: bool = False) -> str:
    """Whole billionths of cost; of each (object, node) the two least labels of unlike last edges."""
    rounds = 24 if ultra else 8  # more than the search takes on the test tables
    spec = "1.0 / (1.0 + ln(d))"
    w = f"sim * ({spec})" if relsim else spec
    last = "sim" if relsim else spec
    hop = "" if ultra else " * 256 + 1"
    units = "floor(greatest(0, 1.0 / ({}) - 1) * 1000000000 + 0.5)::BIGINT" + hop
    add = "greatest(x.d, a.c)" if ultra else "x.d + a.c"
    top = "QUALIFY row_number() OVER (PARTITION BY oid, node ORDER BY min(d), tag) <= 2"
    steps = [f"""d1 AS MATERIALIZED (SELECT oid, node, tag, min(d) AS d FROM (SELECT a.o AS oid, a.s AS node, a.l AS d, CASE WHEN own.sid IS NOT NULL THEN a.s ELSE -1 END AS tag
            FROM arc a JOIN (SELECT DISTINCT oid FROM cand) g ON a.o = g.oid LEFT JOIN own ON own.sid = a.s AND own.pid = a.p AND own.oid = a.o) GROUP BY oid, node, tag {top})"""]
    for h in range(1, rounds):
        steps.append(f"""d{h + 1} AS MATERIALIZED (SELECT oid, node, tag, min(d) AS d FROM (SELECT * FROM d{h} UNION ALL
            SELECT x.oid, a.s, x.tag, {add} FROM d{h} x JOIN arc a ON a.o = x.node WHERE a.s <> x.oid) GROUP BY oid, node, tag {top})""")
    sims = _COOC.format(e="e") + _SIM.format(tf=_LOG) if relsim else ""
    join = "JOIN (SELECT r2, sim FROM sims WHERE r1 = 0) z ON z.r2 = e.p" if relsim else ""
    score = "round(CASE WHEN best IS NULL THEN 0.0 ELSE 1.0 / (1.0 + best" + ("" if ultra else " // 256") + " / 1e9) END, 6) AS score"
    sql = f"""WITH {_KG}{sims}, own AS MATERIALIZED (SELECT sid, pid, oid FROM cand SEMI JOIN e ON e.s = sid AND e.p = pid AND e.o = cand.oid),
        arc AS MATERIALIZED (SELECT s, p, o, {units.format(w)} AS c, {units.format(last)} AS l FROM e JOIN deg ON node = o {join} WHERE {w} > 1 / 1.8e7),
        {", ".join(steps)}, lab AS MATERIALIZED (SELECT oid, node, arg_min(tag, (d, tag)) AS t1, min(d) AS v1, CASE WHEN count(*) > 1 THEN max(d) END AS v2 FROM d{rounds} GROUP BY oid, node),
        fact AS (SELECT cand.sid, cand.pid, cand.oid, CASE WHEN own.sid IS NOT NULL THEN cand.sid ELSE -2 END AS avoid FROM cand LEFT JOIN own USING (sid, pid, oid)),
        f AS MATERIALIZED (SELECT fact.*, CASE WHEN t1 = avoid THEN v2 ELSE v1 END AS best FROM fact LEFT JOIN lab ON lab.oid = fact.oid AND lab.node = fact.sid)"""
    if not paths:
        return f"{sql} SELECT sid, pid, oid, {score} FROM f"
    steps = ["p0 AS (SELECT sid, pid, oid, avoid, sid AS node, best AS need, sid::VARCHAR AS path, '-1' AS rpath FROM f WHERE best IS NOT NULL)"]
    for k in range(rounds):
        steps.append(f"""p{k + 1} AS MATERIALIZED (SELECT * FROM p{k} WHERE node = oid UNION ALL (SELECT sid, pid, x.oid, avoid, a.o, need - CASE WHEN a.o = x.oid THEN l ELSE c END, path || ',' || a.o, rpath || ',' || a.p
            FROM p{k} x JOIN arc a ON a.s = x.node LEFT JOIN lab ON lab.oid = x.oid AND lab.node = a.o
            WHERE x.node <> x.oid AND CASE WHEN a.o = x.oid THEN l = need AND NOT (a.s = avoid AND a.p = pid) ELSE c + CASE WHEN t1 = avoid THEN v2 ELSE v1 END = need END
            QUALIFY row_number() OVER (PARTITION BY sid, pid, x.oid ORDER BY a.o, a.p) = 1))""")
    return f"{sql}, {', '.join(steps)} SELECT sid, pid, oid, {score}, coalesce(path, oid::VARCHAR) AS path, coalesce(rpath, '-1') AS rpath FROM f LEFT JOIN (SELECT sid, pid, oid, path, rpath FROM p{rounds}) USING (sid, pid, oid)"


def _simrank_sql() -> str:
    steps = ["q0 AS (SELECT DISTINCT oid AS f, oid AS w, 1.0::DOUBLE AS pr FROM cand)"]
    for t in range(1, 50):
        steps.append(f"q{t} AS MATERIALIZED (SELECT f, v AS w, sum(pr / d) AS pr FROM q{t - 1} JOIN adj ON u = w JOIN outd USING (u) GROUP BY f, v)")
    steps.append("x49 AS (SELECT * FROM q49)")
    for t in range(48, -1, -1):
        steps.append(f"x{t} AS MATERIALIZED (SELECT f, w, sum(pr) AS pr FROM (SELECT * FROM q{t} UNION ALL SELECT f, u, 0.8 * sum(pr / d) FROM x{t + 1} JOIN adj ON v = w JOIN outd USING (u) GROUP BY f, u) GROUP BY f, w)")
    return f"""WITH {_KG}, outd AS (SELECT u, count(*) AS d FROM adj GROUP BY u), {", ".join(steps)}
        SELECT sid, pid, oid, round(coalesce(0.2 * pr, 0), 6) AS score FROM cand LEFT JOIN x0 ON f = oid AND w = sid"""


_TOPPED = f"WITH {_features(None)}, top AS (SELECT rels, sum(n)::BIGINT AS n FROM feats GROUP BY rels ORDER BY n DESC, string_split(rels, ',')::INT[] LIMIT {_TOP})"


def _pra_sql() -> str:
    """Ends of the top paths from the objects back; r holds a path as a list."""
    return f"""{_TOPPED}, outp AS (SELECT s, p, count(*) AS n FROM e GROUP BY s, p), step AS MATERIALIZED (SELECT s, p, o, 1.0 / n AS share FROM e JOIN outp USING (s, p)),
        listed AS (SELECT rels, string_split(rels, ',')[2:]::INT[] AS r FROM top),
        b1 AS MATERIALIZED (SELECT oid, s AS node, [p] AS t, share AS pr FROM step JOIN (SELECT DISTINCT oid FROM cand) ON o = oid),
        b2 AS MATERIALIZED (SELECT oid, s AS node, [p] || t AS t, sum(pr * share) AS pr FROM b1 JOIN step ON o = node GROUP BY ALL),
        b AS (SELECT * FROM b1 UNION ALL SELECT * FROM b2),
        first AS (SELECT sid, pid, oid, p, o, share, rels, r[2:] AS t FROM cand JOIN step ON s = sid JOIN listed ON r[1] = p)
        SELECT sid, pid, b.oid, rels, round(sum(share * pr), 8) AS value FROM first JOIN b ON b.oid = first.oid AND b.node = first.o AND b.t = first.t GROUP BY sid, pid, b.oid, rels"""


_MI = f"""WITH {_features(200)}, ny AS (SELECT class, count(*) AS ny FROM cand GROUP BY class), nn AS (SELECT count(*) AS nn FROM cand),
    seen AS (SELECT rels, n, class, count(*) AS nxy FROM feats JOIN cand USING (sid, pid, oid) GROUP BY ALL),
    zero AS (SELECT rels, 0 AS n, class, ny - coalesce(k, 0) AS nxy FROM (SELECT DISTINCT rels FROM seen) CROSS JOIN ny LEFT JOIN (SELECT rels, class, sum(nxy) AS k FROM seen GROUP BY ALL) USING (rels, class)),
    cells AS (SELECT * FROM seen UNION ALL SELECT * FROM zero WHERE nxy > 0),
    nx AS (SELECT *, sum(nxy) OVER (PARTITION BY rels, n) AS nx FROM cells)
    SELECT rels, round(sum(nxy / nn * ln(nxy * nn / (nx * ny))), 6) AS mi FROM nx JOIN ny USING (class), nn GROUP BY rels"""

_PATHENT = f"""WITH {_WALKS}, mm AS (SELECT count(*) // 2 AS m FROM e),
    two AS (SELECT * FROM l2 QUALIFY row_number() OVER (PARTITION BY sid, pid, oid ORDER BY r1 DESC, n1 DESC, r2 DESC) <= 201),
    three AS (SELECT * FROM l3 QUALIFY row_number() OVER (PARTITION BY sid, pid, oid ORDER BY r1 DESC, n1 DESC, r2 DESC, n2 DESC, r3 DESC) <= 201),
    links AS (SELECT sid, pid, oid, sid AS a, n1 AS b, 1.0::DOUBLE AS share FROM two UNION ALL SELECT sid, pid, oid, n1, oid, 1.0 FROM two
        UNION ALL SELECT sid, pid, oid, sid, n1, 0.5 FROM three UNION ALL SELECT sid, pid, oid, n1, n2, 0.5 FROM three UNION ALL SELECT sid, pid, oid, n2, oid, 0.5 FROM three
        UNION ALL SELECT sid, pid, oid, sid, oid, -1.0 FROM cand),
    kk AS (SELECT sid, pid, oid, x.d AS ka, y.d AS kb, sum(share) AS share FROM links JOIN deg x ON x.node = a JOIN deg y ON y.node = b GROUP BY ALL),
    ent AS (SELECT ka, kb, -log2(1 - product(greatest(0, m - ka - i) / (m - i))) AS h FROM (SELECT DISTINCT ka, kb, m, unnest(range(kb)) AS i FROM kk, mm) GROUP BY ka, kb)
    SELECT sid, pid, oid, round(sum(share * h), 6) AS score FROM kk JOIN ent USING (ka, kb) GROUP BY ALL"""

_NAMED = """named AS (SELECT c_name AS sub, 'livesIn' AS pred, n_name AS obj FROM customer JOIN nation ON c_nationkey = n_nationkey
        UNION ALL SELECT s_name, 'locatedIn', n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
        UNION ALL SELECT n_name, 'inRegion', r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
    nodes AS (SELECT row_number() OVER (ORDER BY node_name) - 1 AS node_id, node_name FROM (SELECT sub AS node_name FROM named UNION SELECT obj FROM named)),
    rels AS (SELECT (row_number() OVER (ORDER BY relation) - 1)::INT AS rid, relation FROM (SELECT DISTINCT pred AS relation FROM named))"""

_EFFECTIVE = """fs AS (SELECT DISTINCT sid, pid, oid, o AS v FROM cand JOIN e ON s = sid WHERE NOT (o = oid AND p = pid)), fo AS (SELECT DISTINCT oid, v FROM cand JOIN adj ON u = oid)"""

ORACLE_SQL = {
    "kg_edges": f"WITH {_KG} SELECT s, p, o FROM e",
    "kg_directed_edges": f"WITH {_DIRECTED} SELECT s, p, o FROM raw",
    "kg_degree": f"WITH {_KG} SELECT node, d FROM deg",
    "kg_out_degree": f"WITH {_KG} SELECT s AS node, count(*) AS n FROM e GROUP BY s",
    "kg_relation_histogram": f"WITH {_KG} SELECT s AS node, p, count(*) AS n FROM e GROUP BY s, p",
    "kg_dictionary_encode": f"WITH {_NAMED} SELECT a.node_id AS s, rid AS p, b.node_id AS o FROM named JOIN nodes a ON a.node_name = sub JOIN nodes b ON b.node_name = obj JOIN rels ON relation = pred",
    "kg_dictionary_nodes": f"WITH {_NAMED} SELECT node_id, node_name FROM nodes",
    "kg_slice": f"WITH {_KG} SELECT s, o FROM e WHERE p = 1",
    "kg_neighbors": f"WITH {_KG} SELECT p, o FROM e WHERE s = {_NATION + 3}",
    "kg_objects": f"WITH {_KG} SELECT o FROM e WHERE s = {_CUSTOMER + 1} AND p = 3",
    "kg_outgoing_relations": f"WITH {_KG} SELECT p FROM e WHERE s = {_CUSTOMER + 1}",
    "kg_edge_weights": f"WITH {_KG} SELECT s, p, o, round(1 / (1 + ln(d)), 6) AS logdegree, round(1.0 / (1.0 + d), 6)::DOUBLE AS degree FROM e JOIN deg ON node = o",
    "kg_without_candidates": f"WITH {_KG}, rest AS (SELECT * FROM e ANTI JOIN cand ON s = sid AND p = pid AND o = oid) SELECT o AS node, count(DISTINCT s) AS d FROM rest GROUP BY o",
    "kg_update": f"WITH {_KG} SELECT p, CASE WHEN p = 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS w, count(*) AS n FROM e GROUP BY p",
    "lp_jaccard": f"WITH {_SIDES}{_SIZES}, j AS (SELECT *, CASE WHEN ds + dn - c > 0 THEN c / (ds + dn - c) END AS x FROM sized) SELECT sid, pid, oid, class, round(x, 6) AS score, round(exp(x) / sum(exp(x)) OVER (PARTITION BY sid), 6) AS softmaxscore FROM j",
    "lp_jaccard_effective": f"WITH {_KG}, {_EFFECTIVE}{_SIZES} SELECT sid, pid, oid, round(CASE WHEN ds + dn - c > 0 THEN c / (ds + dn - c) END, 6) AS score FROM sized",
    "lp_adamic_adar": f"WITH {_SIDES}, aa AS (SELECT sid, pid, oid, sum(1 / ln(d)) AS x FROM fs JOIN fo USING (oid, v) JOIN deg ON node = v GROUP BY ALL) SELECT sid, pid, oid, round(coalesce(x, 0), 6) AS score FROM cand LEFT JOIN aa USING (sid, pid, oid)",
    "lp_degree_product": f"WITH {_SIDES}{_SIZES} SELECT sid, pid, oid, round((ds * dn)::DOUBLE, 6) AS score FROM sized",
    "lp_katz": f"WITH {_WALKS}, w AS (SELECT sid, pid, oid, 0.0025 AS x FROM l2 UNION ALL SELECT sid, pid, oid, 0.000125 FROM l3), k AS (SELECT sid, pid, oid, sum(x)::DOUBLE AS x FROM w GROUP BY ALL) SELECT sid, pid, oid, round(coalesce(x, 0), 6) AS score FROM cand LEFT JOIN k USING (sid, pid, oid)",
    "lp_katz_effective": f"""WITH {_WALKS}, w AS (SELECT sid, pid, oid, 0.0025 AS x FROM l2 WHERE NOT ((r1 = pid AND n1 = oid) OR (n1 = sid AND r2 = pid))
        UNION ALL SELECT sid, pid, oid, 0.000125 FROM l3 WHERE NOT ((r1 = pid AND n1 = oid) OR (n1 = sid AND r2 = pid AND n2 = oid) OR (n2 = sid AND r3 = pid))), k AS (SELECT sid, pid, oid, sum(x)::DOUBLE AS x FROM w GROUP BY ALL)
        SELECT sid, pid, oid, round(coalesce(x, 0), 6) AS score FROM cand LEFT JOIN k USING (sid, pid, oid)""",
    "lp_pathent": _PATHENT,
    "lp_simrank": _simrank_sql(),
    "walk_count": f"WITH {_WALKS}, w AS (SELECT sid, pid, oid, 1 AS a, 0 AS b FROM l2 UNION ALL SELECT sid, pid, oid, 0, 1 FROM l3) SELECT sid, pid, oid, coalesce(sum(a), 0)::BIGINT AS w2, coalesce(sum(b), 0)::BIGINT AS w3 FROM cand LEFT JOIN w USING (sid, pid, oid) GROUP BY sid, pid, oid",
    "walk_features": f"WITH {_features(None)} SELECT * FROM feats",
    "walk_features_capped": f"WITH {_features(200)} SELECT * FROM feats",
    "walk_listing": f"WITH {_WALKS} SELECT sid, pid, oid, sid || ',' || n1 || ',' || oid AS nodes, '-1,' || r1 || ',' || r2 AS rels FROM l2",
    "walk_listing_three": f"""WITH {_KG}, pairs AS (SELECT 5000000000 + n_nationkey AS sid, 2 AS pid, 6000000000 + r_regionkey AS oid FROM nation, region)
        SELECT sid, pid, oid, sid || ',' || a.o || ',' || b.o || ',' || oid AS nodes, '-1,' || a.p || ',' || b.p || ',' || c.p AS rels
        FROM pairs JOIN e a ON a.s = sid JOIN e c ON c.o = oid JOIN e b ON b.s = a.o AND b.o = c.s""",
    "frequent_path_types": f"{_TOPPED} SELECT rels, n FROM top",
    "rel_cooccurrence": f"WITH {_KG}{_COOC.format(e='e')} SELECT r1, r2, c FROM cooc",
    "rel_cooccurrence_directed": f"WITH {_DIRECTED}{_COOC.format(e='raw')} SELECT r1, r2, c FROM cooc",
    "rel_idf": f"WITH {_KG}{_COOC.format(e='e')}{_SIM.format(tf=_LOG)} SELECT r2, cnt, round(idf, 6) AS idf FROM idf",
    "rel_idf_report": f"WITH {_KG}{_COOC.format(e='e')}{_SIM.format(tf=_LOG)} SELECT r2 AS relation_id, round(idf, 6) AS idf, cnt, row_number() OVER (ORDER BY idf DESC, r2)::INT AS rank, round(idf / max(idf) OVER (), 6) AS idf_norm FROM idf",
    "rel_similarity_logtf": f"WITH {_KG}{_COOC.format(e='e')}{_SIM.format(tf=_LOG)} SELECT r1, r2, round(sim, 6) AS sim FROM sims",
    "rel_similarity_maxtf": f"WITH {_KG}{_COOC.format(e='e')}{_SIM.format(tf=_MAX)} SELECT r1, r2, round(sim, 6) AS sim FROM sims",
    "rel_top_similar": f"WITH {_KG}{_COOC.format(e='e')}{_SIM.format(tf=_LOG)} SELECT r1, r2, round(sim, 6) AS sim FROM sims WHERE r1 = 3 ORDER BY sims.sim DESC, r2 LIMIT 4",
    "closure_kl": _closure_sql(False, False),
    "closure_klrel": _closure_sql(True, False),
    "closure_ultrametric": _closure_sql(True, True),
    "closure_paths": _closure_sql(True, False, paths=True),
    "pra_path_probability": _pra_sql(),
    "predpath_mutual_information": _MI,
    "predpath_first_sightings": f"WITH {_features(None)} SELECT rels, arg_min(class, (sid, oid)) = 1 AS positive FROM feats JOIN cand USING (sid, pid, oid) GROUP BY rels",
    "softmax_normalize": f"WITH {_SIDES}{_SIZES} SELECT sid, pid, oid, round(exp(ds * dn - max(ds * dn) OVER w) / sum(exp(ds * dn - top)) OVER w, 6) AS softmaxscore FROM (SELECT *, max(ds * dn) OVER (PARTITION BY sid) AS top FROM sized) WINDOW w AS (PARTITION BY sid)",
}
