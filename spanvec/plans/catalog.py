"""Every registered query, and its SQL where SQL can say it."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, texts
from ..functions.vectors import dot, doubles, half, half_bits, norm, squared_l2
from ..operators import build, quality, registry, search, verify, versions
from ..sources import tables
from . import dataset as d

Q: dict = {}
SQL: dict[str, str] = {}
DIM, N_LISTS = 64, 10


def _add(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _round(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


def _hits(df: DataFrame) -> DataFrame:
    return _round(df.select("qid", "rn", "id", "shard", "score"), "score")


def _ivf(spark: SparkSession, sf: str, probe: int, k: int = d.K, scan: int = 0) -> DataFrame:
    v = d.vectors(spark, sf)
    return search.ivf_topk(v, build.centroids_of(v), d.queries(spark, sf), k, probe, scan)


_HITS = "SELECT qid, rn, id, shard, round(score, 6) AS score FROM "


@_add("exact_topk", f"WITH {d.V}, {d.exact()} {_HITS} exact")
def exact_topk(spark, sf):
    return _hits(search.exact_topk(d.vectors(spark, sf), d.queries(spark, sf), d.K))


@_add("dot_norm_l2", f"WITH {d.V} SELECT a.id, round(list_inner_product(a.u, b.u), 6) AS dot_next, round(sqrt(list_inner_product(e.x, e.x)), 6) AS norm, round(list_sum(list_transform(list_zip(a.u, b.u), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 6) AS l2_next FROM v a JOIN v b ON b.id = a.id + 1 JOIN e ON e.id = a.id")
def dot_norm_l2(spark, sf):
    v = d.vectors(spark, sf).select("id", "u")
    raw = d.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), norm(doubles(F.col("embedding"))).alias("norm"))
    b = v.select((F.col("id") - 1).alias("id"), F.col("u").alias("b"))
    out = v.join(b, "id").join(raw, "id").select("id", dot(F.col("u"), F.col("b")).alias("dot_next"), "norm", squared_l2(F.col("u"), F.col("b")).alias("l2_next"))
    return _round(out, "dot_next", "norm", "l2_next")


@_add("half_round", f"WITH {d.V} SELECT id, round(list_sum(v), 6) AS total, round(list_max(v), 9) AS largest, round(list_min(v), 9) AS smallest FROM v")
def half_round(spark, sf):
    v = d.vectors(spark, sf)
    return v.select("id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.round(F.array_max("v"), 9).alias("largest"), F.round(F.array_min("v"), 9).alias("smallest"))


_BITS = "CASE WHEN (b >> 15) & 1 = 1 THEN -1.0 ELSE 1.0 END"


@_add("half_decode", f"SELECT b, CASE WHEN (b >> 10) & 31 = 0 THEN {_BITS} * (b & 1023) * pow(2.0, -24) ELSE {_BITS} * (1 + (b & 1023) / 1024) * pow(2.0, ((b >> 10) & 31) - 15) END AS value FROM (SELECT DISTINCT (p_partkey * 37 % 65536)::BIGINT AS b FROM part) WHERE (b >> 10) & 31 < 31")
def half_decode(spark, sf):
    b = d.table(spark, sf, "part").select((F.col("p_partkey") * 37 % 65536).cast("long").alias("b")).distinct()
    return b.where(F.shiftright("b", 10).bitwiseAND(F.lit(31)) < 31).select("b", half_bits(F.col("b")).alias("value"))


@_add("half_range", "SELECT id, CASE WHEN x > 65504 THEN 'over' WHEN x = 0 THEN 'zero' ELSE 'in' END AS kind, round(CASE WHEN x >= 65520 THEN 'inf'::DOUBLE WHEN x > 65504 OR x = 0 THEN least(x, 65504) ELSE round_even(x * pow(2.0, 10 - greatest(floor(log2(x)), -14)), 0) / pow(2.0, 10 - greatest(floor(log2(x)), -14)) END, 9) AS half FROM (SELECT p_partkey::BIGINT AS id, CASE WHEN p_partkey % 5 = 0 THEN 0.0 WHEN p_partkey % 7 = 0 THEN p_retailprice::DOUBLE * 100 ELSE p_retailprice::DOUBLE / 1e7 END AS x FROM part)")
def half_range(spark, sf):
    p, x = d.table(spark, sf, "part"), F.col("x")
    p = p.select(F.col("p_partkey").cast("long").alias("id"), F.when(F.col("p_partkey") % 5 == 0, 0.0).when(F.col("p_partkey") % 7 == 0, F.col("p_retailprice").cast("double") * 100).otherwise(F.col("p_retailprice").cast("double") / 1e7).alias("x"))
    return p.select("id", F.when(x > 65504, "over").when(x == 0, "zero").otherwise("in").alias("kind"), F.round(half(x), 9).alias("half"))


@_add("centroid_mean", f"WITH {d.V}, {d.C} SELECT list_id, (pos - 1)::BIGINT AS pos, round(x, 6) AS x FROM (SELECT list_id, unnest(c) AS x, generate_subscripts(c, 1) AS pos FROM c)")
def centroid_mean(spark, sf):
    c = build.centroids_of(d.vectors(spark, sf))
    return _round(c.select("list_id", F.posexplode("c").alias("pos", "x")).withColumn("pos", F.col("pos").cast("long")), "x")


@_add("single_list", f"WITH {d.V} SELECT 0::BIGINT AS list_id, (pos - 1)::BIGINT AS pos, round(avg(x), 6) AS x FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM v) GROUP BY pos")
def single_list(spark, sf):
    c = build.train(d.vectors(spark, sf), 1)
    return _round(c.select("list_id", F.posexplode("c").alias("pos", "x")).withColumn("pos", F.col("pos").cast("long")), "x")


_L2 = "list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
_ASSIGN = f"a AS MATERIALIZED (SELECT id, list_id FROM (SELECT id, c.list_id, row_number() OVER (PARTITION BY id ORDER BY {_L2}, c.list_id) AS n FROM v, c) WHERE n = 1)"


@_add("l2_assign", f"WITH {d.V}, {d.C}, {_ASSIGN} SELECT id, list_id FROM a")
def l2_assign(spark, sf):
    v = d.vectors(spark, sf)
    return build.assign(v, build.centroids_of(v)).select("id", "list_id")


@_add("lloyd_step", f"WITH {d.V}, {d.C}, {_ASSIGN}, m AS (SELECT list_id, pos, avg(x) AS x FROM (SELECT a.list_id, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM v JOIN a USING (id)) GROUP BY ALL) SELECT list_id, (pos - 1)::BIGINT AS pos, round(x, 6) AS x FROM m UNION ALL SELECT list_id, (pos - 1)::BIGINT, round(x, 6) FROM (SELECT list_id, unnest(c) AS x, generate_subscripts(c, 1) AS pos FROM c WHERE list_id NOT IN (SELECT list_id FROM m))")
def lloyd_step(spark, sf):
    v = d.vectors(spark, sf)
    c = build.lloyd(v, build.centroids_of(v))
    return _round(c.select("list_id", F.posexplode("c").alias("pos", "x")).withColumn("pos", F.col("pos").cast("long")), "x")


@_add("kmeans_train")
def kmeans_train(spark, sf):
    v = d.vectors(spark, sf)
    return build.list_counts(build.assign(v, build.train(v, 16, seed=7)), 16)


@_add("list_counts", f"SELECT r.list_id, count(vec_id)::BIGINT AS n FROM (SELECT unnest(range({N_LISTS + 2})) AS list_id) r LEFT JOIN embeddings e ON e.label = r.list_id GROUP BY 1")
def list_counts(spark, sf):
    return build.list_counts(d.vectors(spark, sf).select("list_id"), N_LISTS + 2)


@_add("list_offsets", f"WITH n AS (SELECT r.list_id, count(vec_id)::BIGINT AS n FROM (SELECT unnest(range({N_LISTS})) AS list_id) r LEFT JOIN embeddings e ON e.label = r.list_id GROUP BY 1) SELECT list_id, n, coalesce(sum(n) OVER w, 0)::BIGINT AS start, (coalesce(sum(4 + n * {8 + 2 * DIM}) OVER w, 0) + 72 + {4 * N_LISTS * DIM})::BIGINT AS \"offset\", 4 + n * {8 + 2 * DIM} AS length FROM n WINDOW w AS (ORDER BY list_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def list_offsets(spark, sf):
    return build.offsets(build.list_counts(d.vectors(spark, sf).select("list_id"), N_LISTS), DIM, N_LISTS)


@_add("offset_validate", f"WITH n AS (SELECT label::BIGINT AS list_id, count(*) AS n FROM embeddings GROUP BY 1), o AS (SELECT list_id, (coalesce(sum(4 + n * {8 + 2 * DIM}) OVER (ORDER BY list_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 72 + {4 * N_LISTS * DIM})::BIGINT AS \"offset\", (4 + n * {8 + 2 * DIM})::BIGINT AS length FROM n) SELECT list_id, \"offset\", length, 20000::BIGINT AS file_size FROM o WHERE \"offset\" < 0 OR length < 0 OR (length <> 0 AND \"offset\" + length > 20000)")
def offset_validate(spark, sf):
    o = list_offsets(spark, sf).select("list_id", "offset", "length", F.lit(20000).cast("long").alias("file_size"))
    return verify.offset_violations(o)


@_add("effective_lists", "SELECT label::BIGINT AS list_id, count(*) AS n, greatest(1, least(1024, count(*)))::BIGINT AS lists, least(1024, greatest(1, count(*) // 39), count(*))::BIGINT AS shard_lists FROM embeddings GROUP BY 1")
def effective_lists(spark, sf):
    n = F.col("n")
    g = d.vectors(spark, sf).groupBy("list_id").agg(F.count(F.lit(1)).alias("n"))
    return g.select("list_id", "n", F.greatest(F.lit(1), F.least(F.lit(1024), n)).cast("long").alias("lists"), F.least(F.lit(1024), F.greatest(F.lit(1), F.floor(n / 39)), n).cast("long").alias("shard_lists"))


@_add("coarse_probe", f"WITH {d.V}, {d.C}, {d.probed(3)} SELECT qid, list_id, prn FROM p")
def coarse_probe(spark, sf):
    return search.coarse(d.queries(spark, sf), build.centroids_of(d.vectors(spark, sf)), 3).select("qid", "list_id", "prn")


@_add("probe_clamp", f"WITH {d.V}, {d.C}, {d.probed(1000)} SELECT qid, count(*) AS n_probes FROM p GROUP BY qid")
def probe_clamp(spark, sf):
    return search.coarse(d.queries(spark, sf), build.centroids_of(d.vectors(spark, sf)), 1000).groupBy("qid").agg(F.count(F.lit(1)).alias("n_probes"))


@_add("ivf_topk_probe3", f"WITH {d.V}, {d.C}, {d.ivf(3)} {_HITS} ivf")
def ivf_topk_probe3(spark, sf):
    return _hits(_ivf(spark, sf, 3))


@_add("nearest_list_best", f"WITH {d.V}, {d.C}, {d.ivf(1, 1)} {_HITS} ivf")
def nearest_list_best(spark, sf):
    return _hits(_ivf(spark, sf, 1, 1))


@_add("ivf_all_lists", f"WITH {d.V}, {d.exact()} {_HITS} exact")
def ivf_all_lists(spark, sf):
    return _hits(_ivf(spark, sf, N_LISTS))


_RECALL = f"""{d.probed(1000)}, at_list AS (SELECT prn FROM exact JOIN v USING (id) JOIN p ON p.qid = exact.qid AND p.list_id = v.list_id),
r AS MATERIALIZED (SELECT probe, (SELECT count(*) FROM at_list WHERE prn <= probe) / (SELECT count(*) FROM exact) AS recall FROM (SELECT DISTINCT prn AS probe FROM p))"""


def _recall(spark, sf):
    v, q = d.vectors(spark, sf), d.queries(spark, sf)
    q = search.asked(q)
    return search.probe_recall(search.exact_topk(v, q, d.K), v, search.coarse(q, build.centroids_of(v), N_LISTS))


@_add("probe_recall", f"WITH {d.V}, {d.C}, {d.exact()}, {_RECALL} SELECT probe, round(recall, 6) AS recall FROM r")
def probe_recall(spark, sf):
    return _round(_recall(spark, sf), "recall")


@_add("ivf_topk_recall90", f"WITH {d.V}, {d.C}, {d.exact()}, {_RECALL}, few AS (SELECT min(probe) AS few FROM r WHERE recall >= 0.9) {_HITS} (SELECT qid, id, shard, list_inner_product(q, v) AS score, row_number() OVER (PARTITION BY qid ORDER BY list_inner_product(q, v) DESC, shard, id) AS rn FROM p JOIN v USING (list_id), few WHERE prn <= few) WHERE rn <= {d.K}")
def ivf_topk_recall90(spark, sf):
    return _hits(_ivf(spark, sf, search.least_probe(_recall(spark, sf), 0.9)))


@_add("max_scan", f"WITH {d.V}, {d.C}, {d.ivf(3, scan=4)} {_HITS} ivf")
def max_scan(spark, sf):
    return _hits(_ivf(spark, sf, 3, scan=4))


@_add("scan_count", f"WITH {d.V}, {d.C}, {d.probed(3)}, n AS (SELECT shard, list_id, least(count(*), 12) AS n FROM v GROUP BY ALL) SELECT qid, sum(n)::BIGINT AS scanned FROM p JOIN n USING (list_id) GROUP BY qid")
def scan_count(spark, sf):
    v = d.vectors(spark, sf)
    return search.scan_counts(v, search.coarse(d.queries(spark, sf), build.centroids_of(v), 3), 12)


@_add("probe_presets", "SELECT n AS n_lists, greatest(1, least(n, floor(n * 0.03125 + 0.5)))::BIGINT AS fast, greatest(1, least(n, floor(n * 0.125 + 0.5)))::BIGINT AS balanced, greatest(1, least(n, floor(n / 5.3 + 0.5)))::BIGINT AS safe FROM (SELECT DISTINCT (p_size * p_size)::BIGINT AS n FROM part)")
def probe_presets(spark, sf):
    n = F.col("n_lists")
    sizes = d.table(spark, sf, "part").select((F.col("p_size") * F.col("p_size")).cast("long").alias("n_lists")).distinct()
    p = lambda x: F.greatest(F.lit(1), F.least(n, F.floor(x + 0.5))).cast("long")
    return sizes.select("n_lists", p(n * 0.03125).alias("fast"), p(n * 0.125).alias("balanced"), p(n / 5.3).alias("safe"))


@_add("confidence_gate", f"WITH {d.V}, {d.exact()}, s AS (SELECT qid, max(score) FILTER (rn = 1) AS s1, max(score) FILTER (rn = 2) AS s2 FROM exact GROUP BY qid) SELECT qid, round(s1, 6) AS s1, round(s2, 6) AS s2, s1 < 0.45 AS low_score, coalesce(s1 - s2 < 0.03, false) AS low_margin FROM s")
def confidence_gate(spark, sf):
    return _round(search.confidence(search.exact_topk(d.vectors(spark, sf), d.queries(spark, sf), d.K)), "s1", "s2")


@_add("shard_topk", f"WITH {d.V} SELECT qid, shard, id, round(score, 6) AS score FROM (SELECT qid, shard, id, list_inner_product(q, v) AS score, row_number() OVER (PARTITION BY qid, shard ORDER BY list_inner_product(q, v) DESC, id) AS n FROM q, v) WHERE n <= {d.K}")
def shard_topk(spark, sf):
    return _round(search.scan_topk(d.vectors(spark, sf), d.queries(spark, sf), d.K), "score")


@_add("meta_left_join", f"WITH {d.V}, {d.exact(3)} SELECT qid, rn, exact.id, lang, source, n_chars FROM exact LEFT JOIN documents ON doc_id = id AND doc_id % 4 <> 1")
def meta_left_join(spark, sf, which="doc_id % 4 <> 1"):
    hits = search.exact_topk(d.vectors(spark, sf), d.queries(spark, sf), 3).select("qid", "rn", "id")
    meta = d.documents(spark, sf).where(which).select(F.col("doc_id").alias("id"), "lang", "source", "n_chars")
    return search.with_meta(hits, meta, ("id",))


@_add("filtered_search", f"WITH {d.V.replace('v AS MATERIALIZED', 'w AS MATERIALIZED').replace('FROM u),', 'FROM u), v AS MATERIALIZED (SELECT w.* FROM w WHERE id IN (SELECT doc_id FROM documents WHERE n_chars >= 600)),', 1)}, {d.exact()} {_HITS} exact")
def filtered_search(spark, sf):
    meta = d.documents(spark, sf).select(F.col("doc_id").alias("id"), "n_chars")
    return _hits(search.exact_topk(search.where_meta(d.vectors(spark, sf), meta, "n_chars >= 600", ("id",)), d.queries(spark, sf), d.K))


@_add("shard_stats", "SELECT (vec_id % 3)::BIGINT AS shard, count(*) AS n_vectors, min(vec_id) AS id_min, max(vec_id) AS id_max FROM embeddings GROUP BY 1")
def shard_stats(spark, sf):
    return build.shard_stats(d.vectors(spark, sf).select("id", "shard"))


@_add("id_generation", "SELECT c_custkey::BIGINT AS c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS id FROM customer")
def id_generation(spark, sf):
    return tables.with_ids(d.table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_acctbal"), None, ["c_acctbal", "c_custkey"]).select("c_custkey", "id")


@_add("id_generation_large", "SELECT l_orderkey::BIGINT AS l_orderkey, l_linenumber::BIGINT AS l_linenumber, copy::BIGINT AS copy, row_number() OVER (ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey, l_suppkey, copy) - 1 AS id FROM lineitem, unnest(range(3)) AS c(copy)")
def id_generation_large(spark, sf):
    rows = d.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("long").alias("l_orderkey"), F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_extendedprice", "l_partkey", "l_suppkey", F.explode(F.array(*(F.lit(i).cast("long") for i in range(3)))).alias("copy")
    )
    return tables.with_ids(rows, None, ["l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "copy"]).select("l_orderkey", "l_linenumber", "copy", "id")


_DIGITS = "CASE WHEN doc_id % 2 = 0 THEN doc_id::VARCHAR ELSE source || '-' || doc_id END"
_IDS = "SELECT k, CASE WHEN regexp_full_match(k, '\\d+') THEN k::BIGINT ELSE row_number() OVER (ORDER BY k) - 1 END AS id FROM"


@_add("digit_ids", f"{_IDS} (SELECT {_DIGITS} AS k FROM documents)")
def digit_ids(spark, sf):
    k = d.documents(spark, sf).select(F.when(F.col("doc_id") % 2 == 0, F.col("doc_id").cast("string")).otherwise(F.concat("source", F.lit("-"), F.col("doc_id"))).alias("k"))
    return tables.digit_ids(k, "k").select("k", "id")


@_add("digit_ids_large", f"{_IDS} (SELECT CASE WHEN l_orderkey % 3 = 0 THEN (l_orderkey * 100 + l_linenumber)::BIGINT::VARCHAR ELSE 'L' || l_orderkey || '-' || l_linenumber END AS k FROM lineitem)")
def digit_ids_large(spark, sf):
    o, n = F.col("l_orderkey"), F.col("l_linenumber")
    k = d.table(spark, sf, "lineitem").select(F.when(o % 3 == 0, (o * 100 + n).cast("long").cast("string")).otherwise(F.concat(F.lit("L"), o, F.lit("-"), n)).alias("k"))
    return tables.digit_ids(k, "k").select("k", "id")


@_add("range_sharding", "SELECT doc_id, doc_id // 64 AS shard, 'pack.shard' || lpad((doc_id // 64)::VARCHAR, 3, '0') AS shard_name FROM documents")
def range_sharding(spark, sf):
    return tables.ranges(d.documents(spark, sf).select("doc_id"), 64, "doc_id")


@_add("row_limit", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 100")
def row_limit(spark, sf):
    return tables.first_rows(d.documents(spark, sf), 100, "doc_id").select("doc_id", "lang")


@_add("text_stringify", "SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang END, 'None') AS text FROM documents")
def text_stringify(spark, sf):
    return d.documents(spark, sf).select("doc_id", texts.stringify(F.when(F.col("doc_id") % 3 != 0, F.col("lang"))).alias("text"))


@_add("snippet", "SELECT doc_id AS id, lang, substr(text, 1, 240) AS snippet FROM documents")
def snippet(spark, sf):
    return tables.metadata(d.documents(spark, sf).withColumnRenamed("doc_id", "id"), "text", ["lang", "absent"], text=False, snippets=True)


@_add("one_line", "SELECT doc_id, regexp_replace(substr(text, 1, 240), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g') AS line FROM documents")
def one_line(spark, sf):
    return d.documents(spark, sf).select("doc_id", texts.one_line(F.col("text")).alias("line"))


@_add("escape_html", "SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS escaped FROM pages")
def escape_html(spark, sf):
    return d.table(spark, sf, "pages").select("page_id", texts.escape_html(F.col("html")).alias("escaped"))


@_add("title_coalesce", "SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 2 = 0 THEN lang ELSE '' END, ''), nullif(CASE WHEN doc_id % 3 = 0 THEN source END, ''), '(id=' || doc_id || ')') AS title FROM documents")
def title_coalesce(spark, sf):
    i = F.col("doc_id")
    return d.documents(spark, sf).select("doc_id", texts.title(F.when(i % 2 == 0, F.col("lang")).otherwise(""), F.when(i % 3 == 0, F.col("source")), i).alias("title"))


@_add("delta_names", "SELECT n_nationkey::BIGINT AS seq, lpad(n_nationkey::VARCHAR, 4, '0') || '.delta' AS name FROM nation")
def delta_names(spark, sf):
    n = d.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("seq"))
    return n.select("seq", texts.delta_name(F.col("seq")).alias("name"))


@_add("vector_literal", "SELECT vec_id, 3::BIGINT AS n, round((label + vec_id / 4 - 0.5)::DOUBLE, 6) AS total FROM embeddings")
def vector_literal(spark, sf):
    e = d.table(spark, sf, "embeddings").select("vec_id", F.concat_ws(", ", F.col("label"), (F.col("vec_id") / 4).cast("string"), F.lit(" -0.5 ")).alias("s"))
    v = e.select("vec_id", texts.parse_vector(F.col("s")).alias("v"))
    return v.select("vec_id", F.size("v").cast("long").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda a, b: a + b), 6).alias("total"))


_SEED = "concat(" + ", ".join(f"substr(h, {15 - 2 * i}, 2)" for i in range(8)) + ")"


@_add("sha_seed", f"SELECT doc_id, {_SEED} AS seed FROM (SELECT doc_id, sha256('7:' || text) AS h FROM documents)")
def sha_seed(spark, sf):
    return d.documents(spark, sf).select("doc_id", hashing.seed_hex(F.col("text"), 7).alias("seed"))


def _lcg(table: str, key: str, dim: int, name: str) -> str:
    xs = ", ".join(f"((s::HUGEINT * {a} + {c}) % 4294967296)::DOUBLE / 4294967295 - 0.5" for a, c in hashing.steps(dim))
    return f"""s_{name} AS (SELECT {key} AS id, ('0x' || substr({_SEED}, 9, 8))::BIGINT AS s FROM (SELECT {key}, sha256('0:' || text) AS h FROM {table})),
w_{name} AS (SELECT id, [{xs}] AS w FROM s_{name}), {name} AS MATERIALIZED (SELECT id, list_transform(w, lambda a: a / sqrt(list_inner_product(w, w))) AS v FROM w_{name})"""


@_add("lcg_embedding", f"WITH {_lcg('documents', 'doc_id', 16, 'x')} SELECT id, (pos - 1)::BIGINT AS pos, round(a, 6) AS x FROM (SELECT id, unnest(v) AS a, generate_subscripts(v, 1) AS pos FROM x)")
def lcg_embedding(spark, sf):
    v = d.documents(spark, sf).select(F.col("doc_id").alias("id"), hashing.hash_embedding(F.col("text"), 16).alias("v"))
    return _round(v.select("id", F.posexplode("v").alias("pos", "x")).withColumn("pos", F.col("pos").cast("long")), "x")


@_add("text_search", f"WITH {_lcg('documents', 'doc_id', 16, 'x')} SELECT qid, id, rn, round(score, 6) AS score FROM (SELECT a.id AS qid, b.id, list_inner_product(a.v, b.v) AS score, row_number() OVER (PARTITION BY a.id ORDER BY list_inner_product(a.v, b.v) DESC, b.id) AS rn FROM x a, x b WHERE a.id % {d.EVERY} = 0) WHERE rn <= 5")
def text_search(spark, sf):
    v = d.documents(spark, sf).select(F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("shard"), hashing.hash_embedding(F.col("text"), 16).alias("v"))
    return _round(search.exact_topk(v, v.where(f"id % {d.EVERY} = 0").select(F.col("id").alias("qid"), F.col("v").alias("q")), 5).select("qid", "id", "rn", "score"), "score", digits=6)


@_add("tombstone_filter", f"WITH {d.V}, {d.T} SELECT seq, id FROM t WHERE id NOT IN (SELECT id FROM dead)")
def tombstone_filter(spark, sf, base="id % 10 < 7"):
    t, dead = d.tiers(spark, sf, base)
    return versions.without_tombstones(t, dead).select("seq", "id")


@_add("override_filter", f"WITH {d.V}, {d.T} SELECT id FROM t WHERE seq = 0 AND id NOT IN (SELECT id FROM t WHERE seq > 0)")
def override_filter(spark, sf, base="id % 10 < 7"):
    return versions.live_base(d.tiers(spark, sf, base)[0]).select("id")


@_add("tiered_search", f"WITH {d.V}, {d.T}, {d.tiered()} SELECT qid, rn, seq, id, round(score, 6) AS score FROM tiered")
def tiered_search(spark, sf, base="id % 10 < 7"):
    t, dead = d.tiers(spark, sf, base)
    return _round(versions.tiered_hits(t, dead, d.queries(spark, sf), d.K).select("qid", "rn", "seq", "id", "score"), "score")


@_add("tiered_revert", f"WITH {d.V}, {d.T}, {d.tiered(seqs='seq <= 1')} SELECT qid, rn, seq, id, round(score, 6) AS score FROM tiered")
def tiered_revert(spark, sf, base="id % 10 < 7"):
    t, dead = d.tiers(spark, sf, base)
    return _round(versions.tiered_hits(versions.revert(t, 1), dead, d.queries(spark, sf), d.K).select("qid", "rn", "seq", "id", "score"), "score")


@_add("rebase", f"WITH {d.V}, {d.T} SELECT id, shard, round(list_sum(v), 6) AS total FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS n FROM t) WHERE n = 1 AND id NOT IN (SELECT id FROM dead)")
def rebase(spark, sf, base="id % 10 < 7"):
    return versions.rebase(*d.tiers(spark, sf, base)).select("id", "shard", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@_add("promote", f"WITH {d.V}, {d.T}, n AS (SELECT coalesce(max(seq), 0) + 1 AS n FROM t WHERE seq > 0) SELECT seq, count(*) AS n_rows FROM (SELECT seq FROM t UNION ALL SELECT n.n FROM t, n WHERE seq = 1) GROUP BY seq")
def promote(spark, sf, base="id % 10 < 7"):
    t, _ = d.tiers(spark, sf, base)
    return versions.promote(t, t.where("seq = 1")).groupBy("seq").agg(F.count(F.lit(1)).alias("n_rows"))


@_add("next_seq", f"WITH {d.V}, {d.T} SELECT coalesce(max(seq), 0) + 1 AS next_seq FROM t WHERE seq > 0")
def next_seq(spark, sf, base="id % 10 < 7"):
    return versions.next_seq(d.tiers(spark, sf, base)[0])


# the queries above leave rows out, so that some are missing; these run over all vectors and documents
for _name in ("tombstone_filter", "override_filter", "tiered_search", "tiered_revert", "rebase", "promote", "next_seq"):
    _add(f"{_name}_all", SQL[_name].replace(d.T, d.T_ALL))(partial(Q[_name], base="true"))
_add("meta_left_join_all", SQL["meta_left_join"].replace(" AND doc_id % 4 <> 1", ""))(partial(Q["meta_left_join"], which="true"))


_COMPARE = f"""ea AS (SELECT qid, list(id ORDER BY rn) AS a FROM exact GROUP BY qid), ib AS (SELECT qid, list(id ORDER BY rn) AS b FROM ivf GROUP BY qid),
ab AS MATERIALIZED (SELECT qid, a, b, list_filter(a, lambda x: list_contains(b, x)) AS m FROM ea JOIN ib USING (qid)),
pr AS (SELECT qid, sum(sign(list_position(b, m[j]) - list_position(b, m[i]))) AS s FROM ab, unnest(range(1, len(m) + 1)) AS r(i), unnest(range(1, len(m) + 1)) AS z(j) WHERE i < j GROUP BY qid),
mt AS MATERIALIZED (SELECT qid, len(m) / {d.K} AS overlap, len(m) / len(list_distinct(list_concat(a, b))) AS jaccard, CASE WHEN len(m) < 2 THEN 1.0 ELSE s / (len(m) * (len(m) - 1) / 2) END AS tau FROM ab LEFT JOIN pr USING (qid))"""
_BOTH = f"WITH {d.V}, {d.C}, {d.exact()}, {d.ivf(2)}, {_COMPARE}"


def _metrics(spark, sf):
    v, q = d.vectors(spark, sf), search.asked(d.queries(spark, sf))
    return quality.compare(search.exact_topk(v, q, d.K), search.ivf_topk(v, build.centroids_of(v), q, d.K, 2), q.df, d.K)


@_add("rank_metrics", f"{_BOTH} SELECT qid, round(overlap, 6) AS overlap, round(jaccard, 6) AS jaccard, round(tau, 6) AS tau FROM mt")
def rank_metrics(spark, sf):
    return _round(_metrics(spark, sf), "overlap", "jaccard", "tau")


@_add("fidelity_gate", f"{_BOTH} SELECT round(avg(overlap), 6) AS avg_overlap, round(min(overlap), 6) AS min_overlap, round(avg(jaccard), 6) AS avg_jaccard, round(avg(tau), 6) AS avg_tau, count(*) AS n_queries, avg(overlap) >= 0.9 AND min(overlap) >= 0.7 AND avg(tau) >= 0.8 AS passed FROM mt")
def fidelity_gate(spark, sf):
    return _round(quality.gate(_metrics(spark, sf)), "avg_overlap", "min_overlap", "avg_jaccard", "avg_tau")


@_add("canary", f"{_BOTH} SELECT round(avg(overlap), 6) AS avg_overlap, round(min(overlap), 6) AS min_overlap, count(*) AS n_queries, avg(overlap) >= 0.8 AND min(overlap) >= 0.7 AS passed FROM mt")
def canary(spark, sf):
    v, q = d.vectors(spark, sf), search.asked(d.queries(spark, sf))
    return _round(quality.canary(search.exact_topk(v, q, d.K), search.ivf_topk(v, build.centroids_of(v), q, d.K, 2), q.df, d.K), "avg_overlap", "min_overlap")


@_add("query_sample", "SELECT item_id FROM benchmark ORDER BY sha256('42:' || item_id) LIMIT 20")
def query_sample(spark, sf):
    return quality.sample_queries(d.table(spark, sf, "benchmark").select("item_id"), 20, key="item_id")


def _catalog(spark, sf):
    c = registry.empty(spark)
    region, nation, supplier = (d.table(spark, sf, t) for t in ("region", "nation", "supplier"))
    c["orgs"] = registry.insert(c["orgs"], region.select(F.col("r_regionkey").cast("long").alias("org_id"), F.col("r_name").alias("name")), ["name"])
    c["projects"] = registry.insert(c["projects"], nation.select(F.col("n_nationkey").cast("long").alias("project_id"), F.col("n_regionkey").cast("long").alias("org_id"), F.col("n_name").alias("name")), ["org_id", "name"])
    v = supplier.select(
        F.col("s_suppkey").cast("long").alias("version_id"), F.col("s_nationkey").cast("long").alias("project_id"), F.concat(F.lit("v"), "s_suppkey").alias("version"),
        F.concat(F.lit("/packs/"), "s_suppkey").alias("path"), F.sha2(F.col("s_suppkey").cast("string"), 256).alias("sha256"), (F.col("s_suppkey") % 7).cast("double").alias("created_at"),
    )
    c["versions"] = registry.insert(c["versions"], v, ["project_id", "version"])
    return c


@_add("catalog_versions", "SELECT 'v' || s_suppkey AS version, '/packs/' || s_suppkey AS path, sha256(s_suppkey::VARCHAR) AS sha256, (s_suppkey % 7)::DOUBLE AS created_at FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_nationkey = (SELECT s_nationkey FROM supplier ORDER BY s_suppkey LIMIT 1)")
def catalog_versions(spark, sf):
    s = d.table(spark, sf, "supplier").orderBy("s_suppkey").select(F.col("s_nationkey").alias("n_nationkey")).limit(1)
    r = s.join(d.table(spark, sf, "nation"), "n_nationkey").join(d.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).first()
    return registry.list_versions(_catalog(spark, sf), r.r_name, r.n_name)


@_add("catalog_projects", "SELECT r_name AS org, n_name AS project, n_nationkey::BIGINT AS project_id FROM nation JOIN region ON n_regionkey = r_regionkey")
def catalog_projects(spark, sf):
    c = _catalog(spark, sf)
    return c["projects"].withColumnRenamed("name", "project").join(c["orgs"].withColumnRenamed("name", "org"), "org_id").select("org", "project", "project_id")


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
