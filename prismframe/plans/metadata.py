"""Queries of the metadata plane - loader, store, geometry, statistics, hashes - each with the SQL it must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismframe.functions import crops, hashing
from prismframe.functions.rng import batch_seed, between, row_seed, uniform
from prismframe.operators import fallback, ordinal, store
from prismframe.operators.loader import Loader

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def meta(spark: SparkSession, d: str) -> DataFrame:
    """Image-like rows: sizes and labels derived from part."""
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k.alias("_idx"), (64 + k * 37 % 577).alias("width"), (64 + (k * 53 + 11) % 449).alias("height"), F.col("p_size").cast("long").alias("label"), F.col("p_brand").alias("brand"))


META = "m AS (SELECT p_partkey AS _idx, 64 + p_partkey*37%577 AS width, 64 + (p_partkey*53+11)%449 AS height, CAST(p_size AS BIGINT) AS label, p_brand AS brand FROM part)"


def u(salt: str, key: str = "_idx") -> str:
    """uniform() in SQL; salt and key are SQL expressions or plain salts."""
    salt = salt if salt.startswith("(") else f"'{salt}'"
    return f"(CAST(('0x' || substr(md5({salt} || '|' || CAST({key} AS VARCHAR)),1,8)) AS BIGINT) / 4294967296.0::DOUBLE)"


def half_up(x, digits: int):
    """A double rounded as SQL engines that have no exact decimals do it: scaled, moved by one half, cut. F.round() looks at the decimal digits, which differs where ties are many."""
    return F.floor(x * 10.0**digits + F.lit(0.5)) / F.lit(10.0**digits)


def epoch(n: int, source: str = "m", key: str = "_idx") -> str:
    return f"o AS (SELECT *, row_number() OVER (ORDER BY {u(f'epoch{n}', key)}, {key}) - 1 AS _pos FROM {source})"


# --- loader -------------------------------------------------------------------------


@query(f"WITH {META}, {epoch(42)} SELECT _idx, _pos, _pos // 32 AS _batch, _pos % 32 AS _slot, width, height, label FROM o WHERE _pos // 32 < (SELECT count(*) FROM m) // 32")
def loader_epoch_shuffle(spark, d):
    return Loader(meta(spark, d), 32, seed=42, exclude=("brand",)).plan()


@query(f"WITH {META}, {epoch(45)} SELECT _idx, _pos, _pos // 32 AS _batch, _pos % 32 AS _slot FROM o WHERE _pos // 32 < (SELECT count(*) FROM m) // 32")
def loader_set_epoch(spark, d):
    return Loader(meta(spark, d), 32, seed=42).set_epoch(3).plan().select("_idx", "_pos", "_batch", "_slot")


@query("WITH s AS (SELECT doc_id AS _idx, doc_id AS _at FROM labels UNION ALL SELECT doc_id, doc_id + 1000000000 FROM labels WHERE doc_id % 7 = 0), o AS (SELECT *, row_number() OVER (ORDER BY " + u("epoch7", "_at") + ", _at) - 1 AS _pos FROM s) SELECT o._idx, _pos, _pos // 16 AS _batch, _pos % 16 AS _slot, d.n_chars FROM o JOIN documents d ON d.doc_id = o._idx")
def loader_subset_indices(spark, d):
    ids = table(spark, d, "labels").select(F.col("doc_id").alias("_idx"), F.col("doc_id").alias("_at"))
    ids = ids.unionByName(ids.where("_idx % 7 = 0").withColumn("_at", F.col("_at") + 1000000000))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("_idx"), "n_chars")
    return Loader(docs, 16, seed=7, indices=ids, drop_last=False).plan()


_SHARD = f"WITH {META}, {epoch(5)}, n AS (SELECT count(*) AS n, ((count(*) + 6) // 7) * 7 - count(*) AS short FROM m), p AS (SELECT _idx, _pos FROM o UNION ALL SELECT _idx, _pos + n FROM o, n WHERE _pos < short)"


@query(_SHARD + " SELECT _idx, _pos // 7 AS _pos FROM p WHERE _pos % 7 = 3")
def loader_shard_rank(spark, d):
    return Loader(meta(spark, d), 32, seed=5, world=7, rank=3).order()


@query(_SHARD + " SELECT _pos % 7 AS rank, count(*) AS n, CAST(sum(_idx) AS BIGINT) AS ids FROM p GROUP BY 1")
def loader_pad_even(spark, d):
    parts = [Loader(meta(spark, d), 32, seed=5, world=7, rank=r).order().select(F.lit(r).cast("long").alias("rank"), "_idx") for r in range(7)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("rank").agg(F.count("*").alias("n"), F.sum("_idx").alias("ids"))


@query(f"WITH {META}, o AS (SELECT *, row_number() OVER (ORDER BY _idx) - 1 AS _pos FROM m) SELECT _pos // 48 AS _batch, count(*) AS n FROM o WHERE _pos // 48 < (SELECT count(*) FROM m) // 48 GROUP BY 1")
def loader_drop_last(spark, d):
    return Loader(meta(spark, d), 48, shuffle=False).plan().groupBy("_batch").agg(F.count("*").alias("n"))


@query(f"WITH {META}, o AS (SELECT *, row_number() OVER (ORDER BY _idx) - 1 AS _pos FROM m) SELECT _pos // 48 AS _batch, count(*) AS n, min(_idx) AS first_idx FROM o GROUP BY 1")
def loader_partial_batch(spark, d):
    return Loader(meta(spark, d), 48, shuffle=False, drop_last=False).plan().groupBy("_batch").agg(F.count("*").alias("n"), F.min("_idx").alias("first_idx"))


@query("SELECT w AS world, b AS batch_size, CAST(((SELECT count(*) FROM part) + w - 1) // w // b AS BIGINT) AS full_batches, CAST((((SELECT count(*) FROM part) + w - 1) // w + b - 1) // b AS BIGINT) AS all_batches FROM (SELECT CAST(unnest([1,2,7]) AS BIGINT) w), (SELECT CAST(unnest([16,48,256]) AS BIGINT) b)")
def loader_len(spark, d):
    n = table(spark, d, "part").count()
    rows = [(w, b, len(Loader(None, b, world=w, rows=n)), len(Loader(None, b, world=w, rows=n, drop_last=False))) for w in (1, 2, 7) for b in (16, 48, 256)]
    return spark.createDataFrame(rows, "world long, batch_size long, full_batches long, all_batches long")


@query(f"WITH {META}, o AS (SELECT *, row_number() OVER (ORDER BY _idx) - 1 AS _pos FROM m) SELECT _pos // 64 AS _batch, list(label ORDER BY _pos) AS labels, list(_idx ORDER BY _pos) AS ids FROM o WHERE _pos // 64 < (SELECT count(*) FROM m) // 64 GROUP BY 1")
def loader_collate(spark, d):
    rows = Loader(meta(spark, d), 64, shuffle=False).batches(["label", "_idx"])
    return rows.select("_batch", F.col("rows.label").alias("labels"), F.col("rows._idx").alias("ids"))


@query("SELECT _pos, o_orderkey, o_custkey FROM (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY " + u("epoch1", "o_orderkey") + ", o_orderkey) - 1 AS _pos FROM orders) WHERE _pos < 256 * ((SELECT count(*) FROM orders) // 256)")
def loader_orders_shuffle(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("_idx"), "o_orderkey", "o_custkey")
    return Loader(rows, 256, seed=1).plan().select("_pos", "o_orderkey", "o_custkey")


# --- store --------------------------------------------------------------------------


def blobs(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("_idx"), "text", "lang", "source", F.col("n_chars").alias("n"))


@query("SELECT doc_id AS _idx, CAST(octet_length(encode(text)) AS BIGINT) AS size, CAST(coalesce(sum(octet_length(encode(text))) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ptr FROM documents")
def store_pointers(spark, d):
    return store.pointers(blobs(spark, d), "text").select("_idx", "size", "ptr")


@query("SELECT a.at AS _at, d.doc_id AS _idx, d.lang, d.n_chars AS n FROM (SELECT doc_id AS at, doc_id // 2 * 13 % (SELECT count(*) FROM documents) AS id FROM labels) a JOIN documents d ON d.doc_id = a.id")
def store_load_batch_spread(spark, d):
    rows = blobs(spark, d)
    ids = table(spark, d, "labels").select(F.col("doc_id").alias("_at"), (F.floor(F.col("doc_id") / 2) * 13).alias("k"))
    ids = ids.crossJoin(rows.agg(F.count("*").alias("c"))).select("_at", (F.col("k") % F.col("c")).alias("_idx"))
    return store.load_batch(rows, ids, ["lang", "n"]).select("_at", "_idx", "lang", "n")


@query("SELECT event_id AS _idx, CAST(user_id AS BIGINT) AS user_id, CAST(value AS DOUBLE) AS value, props FROM events")
def store_numeric_cast(spark, d):
    rows = table(spark, d, "events").select(F.col("event_id").alias("_idx"), "user_id", "value", "props")
    return store.typed(rows, {"user_id": "int", "value": "float32", "props": "str"})


@query("SELECT p_partkey AS _idx, CAST(octet_length(encode(p_name)) AS BIGINT) AS size, CAST(coalesce(sum(octet_length(encode(p_name))) OVER (ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM part")
def store_string_offsets(spark, d):
    return store.pointers(table(spark, d, "part").select(F.col("p_partkey").alias("_idx"), "p_name"), "p_name", "off").select("_idx", "size", "off")


@query("SELECT doc_id AS _idx, n_chars AS n FROM documents UNION ALL SELECT doc_id + 1 + (SELECT max(doc_id) FROM documents), n_chars FROM documents")
def store_merge_whole_shards(spark, d):
    rows = blobs(spark, d).select("_idx", "n")
    return store.merged([rows, rows], [0, (rows.agg(F.max("_idx")).first()[0] or 0) + 1])


@query("SELECT doc_id AS _idx, CASE WHEN doc_id % 50 = 0 THEN 'missing' ELSE 'differs' END AS problem FROM documents WHERE doc_id % 50 = 0 OR doc_id % 31 = 0")
def store_verify_hash(spark, d):
    rows = blobs(spark, d)
    other = rows.where("_idx % 50 <> 0").withColumn("text", F.when(F.col("_idx") % 31 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return store.differing(rows, other, "text")


@query("SELECT label AS value, list(vec_id ORDER BY vec_id) AS rows FROM (SELECT CAST(label AS BIGINT) AS label, vec_id FROM embeddings) GROUP BY 1")
def index_numeric(spark, d):
    return store.index(table(spark, d, "embeddings").select(F.col("vec_id").alias("_idx"), F.col("label").cast("long").alias("label")), "label")


@query("SELECT source AS value, list(doc_id ORDER BY doc_id) AS rows FROM documents GROUP BY 1")
def index_string(spark, d):
    return store.index(blobs(spark, d), "source")


@query("SELECT doc_id AS _idx, lang FROM documents WHERE lang IN ('de', 'fr')")
def index_lookup_subset(spark, d):
    rows = blobs(spark, d)
    return store.lookup(rows, "lang", ["de", "fr"]).select("_idx", F.col("value").alias("lang"))


@query("SELECT source AS value, doc_id // 512 AS block, list(doc_id ORDER BY doc_id) AS rows FROM documents GROUP BY 1, 2")
def index_in_blocks(spark, d):
    return store.index_blocks(blobs(spark, d), "source", 512)


@query("SELECT f AS field, unnest(CASE t WHEN 'str' THEN [f || '.bin', f || '.offsets.npy'] WHEN 'ImageBytes' THEN [f || '.bin', f || '.meta.npy'] ELSE [f || '.npy'] END) AS file FROM (VALUES ('image','ImageBytes'),('label','int'),('path','str'),('score','float')) v(f,t)")
def expected_files(spark, d):
    fields = {"image": "ImageBytes", "label": "int", "path": "str", "score": "float"}
    return spark.createDataFrame([(f, x) for f, t in fields.items() for x in store.expected_files(f, t)], "field string, file string")


# --- geometry -----------------------------------------------------------------------

def W():
    return F.col("width")


def H():
    return F.col("height")


def K():
    return F.col("_idx")


def r5(x: str) -> str:
    return f"CAST(floor({x} + 0.5) AS BIGINT)"


def boxes(df: DataFrame, box) -> DataFrame:
    return df.select("_idx", box.alias("b")).select("_idx", "b.x", "b.y", "b.w", "b.h")


@query(f"WITH {META} SELECT _idx, (width-s)//2 AS x, (height-s)//2 AS y, s AS w, s AS h FROM (SELECT *, least(224,width,height) AS s FROM m)")
def crop_center(spark, d):
    return boxes(meta(spark, d), crops.centre(W(), H(), 224))


@query(f"WITH {META}, c AS (SELECT *, least(224,width,height) AS s FROM m), q AS (SELECT *, (width-s)//2 AS cx, (height-s)//2 AS cy FROM c) SELECT _idx, cx//8*8 AS x, cy//8*8 AS y, least((s+cx%8+7)//8*8, width-cx//8*8) AS w, least((s+cy%8+7)//8*8, height-cy//8*8) AS h FROM q")
def crop_center_mcu(spark, d):
    return boxes(meta(spark, d), crops.aligned(crops.centre(W(), H(), 224), W(), H()))


@query(f"WITH {META} SELECT _idx, width//8*8 AS low, (width+7)//8*8 AS high, width//16*16 AS low16 FROM m")
def mcu_align(spark, d):
    return meta(spark, d).select("_idx", crops.align(W()).alias("low"), crops.align(W(), up=True).alias("high"), crops.align(W(), 16).alias("low16"))


def about_sql(cw: str = "cw", ch: str = "ch") -> str:
    x = f"least(greatest(cx*width, {cw}/2.0), width-{cw}/2.0) - {cw}/2.0"
    y = f"least(greatest(cy*height, {ch}/2.0), height-{ch}/2.0) - {ch}/2.0"
    return f"least(greatest({r5(x)},0), width-{cw}) AS x, least(greatest({r5(y)},0), height-{ch}) AS y, {cw} AS w, {ch} AS h"


def direct_sql(salt: str, low: float, high: float, rlow: float, rhigh: float) -> str:
    return f"""
 a AS (SELECT *, {u(salt + '/cx')} AS cx, {u(salt + '/cy')} AS cy, greatest({rlow!r}::DOUBLE, width::DOUBLE*{low!r}::DOUBLE/height) AS lo, least({rhigh!r}::DOUBLE, width::DOUBLE/(height::DOUBLE*{low!r}::DOUBLE)) AS hi FROM m),
 b AS (SELECT *, exp(ln(lo) + {u(salt + '/r')} * (ln(hi)-ln(lo))) AS r FROM a),
 e AS (SELECT *, width::DOUBLE*height::DOUBLE*({low!r}::DOUBLE + {u(salt + '/s')} * (greatest(least({high!r}::DOUBLE, width::DOUBLE/height/r, height::DOUBLE*r/width), {low!r}::DOUBLE) - {low!r}::DOUBLE)) AS area FROM b),
 f AS (SELECT *, greatest(least({r5('sqrt(area*r)')}, width),1) AS cw, greatest(least({r5('sqrt(area/r)')}, height),1) AS ch, least(width,height) AS s FROM e),
 g AS (SELECT _idx, {about_sql()}, lo > hi AS bad, width, height, s FROM f)"""


_DIRECT_OUT = " SELECT _idx, CASE WHEN bad THEN (width-s)//2 ELSE x END AS x, CASE WHEN bad THEN (height-s)//2 ELSE y END AS y, CASE WHEN bad THEN s ELSE w END AS w, CASE WHEN bad THEN s ELSE h END AS h FROM g"


@query(f"WITH {META}, {direct_sql('rrc', 0.08, 1.0, 0.75, 4 / 3)}{_DIRECT_OUT}")
def crop_direct_rrc(spark, d):
    return boxes(meta(spark, d), crops.direct_resized(W(), H(), K()))


def rejection_sql(salt: str, low: float, high: float, rlow: float, rhigh: float) -> str:
    import math

    a, b = math.log(rlow), math.log(rhigh)
    return f"""
 t AS (SELECT *, unnest(range(10)) AS k FROM m),
 q AS (SELECT *, width*height*({low!r}::DOUBLE + {u(f"('{salt}/s' || k)")} * {high - low!r}::DOUBLE) AS area, exp({a!r}::DOUBLE + {u(f"('{salt}/r' || k)")} * {b - a!r}::DOUBLE) AS r FROM t),
 z AS (SELECT *, {r5('sqrt(area*r)')} AS cw, {r5('sqrt(area/r)')} AS ch FROM q),
 y AS (SELECT _idx, arg_min(cw,k) AS cw, arg_min(ch,k) AS ch FROM z WHERE cw>0 AND cw<=width AND ch>0 AND ch<=height GROUP BY 1),
 f AS (SELECT m.*, y.cw, y.ch, {u(salt + '/cx', 'm._idx')} AS cx, {u(salt + '/cy', 'm._idx')} AS cy, least(width,height) AS s FROM m LEFT JOIN y ON m._idx = y._idx),
 g AS (SELECT _idx, {about_sql()}, cw IS NULL AS bad, width, height, s FROM f)"""


@query(f"WITH {META}, {rejection_sql('rrc', 0.08, 1.0, 0.75, 4 / 3)}{_DIRECT_OUT}")
def crop_rrc_rejection(spark, d):
    return boxes(meta(spark, d), crops.random_resized(W(), H(), K()))


@query(f"WITH {META}, {rejection_sql('wide', 0.5, 1.0, 0.75, 4 / 3)}{_DIRECT_OUT}")
def crop_rrc_fallback(spark, d):
    return boxes(meta(spark, d), crops.random_resized(W(), H(), K(), "wide", (0.5, 1.0)))


@query(f"WITH {META}, {rejection_sql('rrc', 0.08, 1.0, 0.75, 4 / 3)}, v AS ({_DIRECT_OUT[1:].replace('FROM g', ', width, height FROM g', 1).replace(' , width', ', width')}) SELECT _idx, x//8*8 AS x, y//8*8 AS y, least((w+x%8+7)//8*8, width-x//8*8) AS w, least((h+y%8+7)//8*8, height-y//8*8) AS h FROM v")
def crop_rrc_mcu(spark, d):
    return boxes(meta(spark, d), crops.aligned(crops.random_resized(W(), H(), K()), W(), H()))




def resized_sql(t: str) -> str:
    return f"z AS (SELECT *, CASE WHEN height<width THEN ({t})::DOUBLE/height ELSE ({t})::DOUBLE/width END AS s FROM m), n AS (SELECT *, CASE WHEN height<width THEN {r5('width*s')} ELSE {t} END AS nw, CASE WHEN height<width THEN {t} ELSE {r5('height*s')} END AS nh FROM z)"


_INSIDE = "i AS (SELECT _idx, width, height, least(greatest(x0,0),width-1) AS x, least(greatest(y0,0),height-1) AS y, w0, h0 FROM q) SELECT _idx, x, y, greatest(least(w0,width-x),1) AS w, greatest(least(h0,height-y),1) AS h FROM i"


@query(f"WITH {META}, {resized_sql('256')}, q AS (SELECT _idx, width, height, {r5('((nw-least(224,nw))//2)/s')} AS x0, {r5('((nh-least(224,nh))//2)/s')} AS y0, {r5('least(224,nw)/s')} AS w0, {r5('least(224,nh)/s')} AS h0 FROM n), {_INSIDE}")
def crop_resize_crop(spark, d):
    return boxes(meta(spark, d), crops.resize_centre(W(), H()))


def short_sql(t: str, x: str, y: str) -> str:
    return f"{resized_sql(t)}, q AS (SELECT _idx, width, height, {r5(f'floor({x}*greatest(nw-{t},0))/s')} AS x0, {r5(f'floor({y}*greatest(nh-{t},0))/s')} AS y0, {r5(f'{t}/s')} AS w0, {r5(f'{t}/s')} AS h0 FROM n), {_INSIDE}"


@query(f"WITH {META}, {short_sql('224', u('slide/x'), u('slide/y'))}")
def crop_resize_short_crop_long(spark, d):
    return boxes(meta(spark, d), crops.short_crop_long(W(), H(), F.lit(224), uniform("slide/x", K()), uniform("slide/y", K())))


_PER_IMAGE = f"(128 + CAST(floor({u('size')} * 97) AS BIGINT))"


@query(f"WITH {META}, {short_sql(_PER_IMAGE, '0.5::DOUBLE', '0.5::DOUBLE')}")
def crop_rsl_per_image_size(spark, d):
    return boxes(meta(spark, d), crops.short_crop_long(W(), H(), 128 + F.floor(uniform("size", K()) * 97), F.lit(0.5), F.lit(0.5)))


_PER_BATCH = f"(128 + CAST(floor({u('size', '(_idx // 32)')} * 97) AS BIGINT))"


@query(f"WITH {META}, {short_sql(_PER_BATCH, '0.5::DOUBLE', '0.5::DOUBLE')}")
def crop_rsl_per_batch_size(spark, d):
    return boxes(meta(spark, d), crops.short_crop_long(W(), H(), 128 + F.floor(uniform("size", F.floor(K() / 32)) * 97), F.lit(0.5), F.lit(0.5)))


@query(f"WITH {META}, {direct_sql('yoke', 0.3, 1.0, 1.0, 1.0)}, big AS ({_DIRECT_OUT[1:]}), " + direct_sql("yoke", 0.05, 0.3, 1.0, 1.0).replace(" a AS", " a2 AS").replace("FROM a)", "FROM a2)").replace(" b AS", " b2 AS").replace("FROM b)", "FROM b2)").replace(" e AS", " e2 AS").replace("FROM e)", "FROM e2)").replace(" f AS", " f2 AS").replace("FROM f)", "FROM f2)").replace(" g AS", " g2 AS") + f", small AS ({_DIRECT_OUT[1:].replace('FROM g', 'FROM g2')}) SELECT 'global' AS view, * FROM big UNION ALL SELECT 'local', * FROM small")
def crop_yoked(spark, d):
    m = meta(spark, d)
    one = lambda name, scale: m.select(F.lit(name).alias("view"), "_idx", crops.direct_resized(W(), H(), K(), "yoke", scale, (1.0, 1.0)).alias("b")).select("view", "_idx", "b.x", "b.y", "b.w", "b.h")
    return one("global", (0.3, 1.0)).unionByName(one("local", (0.05, 0.3)))


@query(f"WITH {META}, t AS (SELECT _idx, width AS cw, height AS ch FROM m WHERE width < 400), q AS (SELECT *, CAST(floor({u('embed/x')}*greatest(256-cw,0)) AS BIGINT) AS x, CAST(floor({u('embed/y')}*greatest(256-ch,0)) AS BIGINT) AS y FROM t) SELECT _idx, x, y, least(cw,256-x) AS w, least(ch,256-y) AS h FROM q")
def embed_rect_range(spark, d):
    return boxes(meta(spark, d).where("width < 400"), crops.embed_rect(W(), H(), 256, uniform("embed/x", K()), uniform("embed/y", K())))


@query(f"WITH {META}, q AS (SELECT _idx, label*6 - width//2 AS x, label*5 - height//2 AS y, width AS cw, height AS ch FROM m), t AS (SELECT _idx, greatest(x,0) AS x, greatest(y,0) AS y, least(cw-greatest(-x,0),256-greatest(x,0)) AS w, least(ch-greatest(-y,0),256-greatest(y,0)) AS h FROM q) SELECT * FROM t WHERE w>0 AND h>0")
def embed_rect_coords(spark, d):
    return boxes(meta(spark, d), crops.embed_centre(W(), H(), 256, F.col("label") * 6, F.col("label") * 5)).where("w is not null")


@query(f"WITH {META}, s AS (SELECT _idx, width, row_number() OVER () AS o, unnest([1,1,3,1,5,3,7,1]) AS n, unnest([8,4,8,2,8,4,8,1]) AS d, unnest(range(8)) AS k FROM m), f AS (SELECT _idx, coalesce(min(CASE WHEN width*n//d >= 200 THEN k END), 7) AS k FROM s GROUP BY 1) SELECT _idx, CAST([1,1,3,1,5,3,7,1][k+1] AS BIGINT) AS n, CAST([8,4,8,2,8,4,8,1][k+1] AS BIGINT) AS d FROM f")
def scale_factor(spark, d):
    return meta(spark, d).select("_idx", crops.best_scale(W(), 200).alias("s")).select("_idx", "s.n", "s.d")


@query(f"WITH {META} SELECT _idx, (42 + 32 * (_idx // 32 + 1)) % 2147483647 AS batch_seed, ((42 + 32 * (_idx // 32 + 1)) % 2147483647 + _idx % 32) % 2147483647 AS row_seed FROM m")
def seed_formula(spark, d):
    b = batch_seed(42, F.lit(32), F.floor(K() / 32) + 1)
    return meta(spark, d).select("_idx", b.alias("batch_seed"), row_seed(b, F.pmod(K(), F.lit(32))).alias("row_seed"))


@query(f"WITH {META}, g AS (SELECT DISTINCT width, height FROM m), t AS (SELECT *, unnest(range(200)) AS k FROM g), q AS (SELECT *, {u('fall/s', '(width*100000000+height*10000+k)')} AS us, {u('fall/r', '(width*100000000+height*10000+k)')} AS ur FROM t), z AS (SELECT width, height, width*height*(0.5::DOUBLE+us*0.5::DOUBLE) AS area, exp(ln(0.75::DOUBLE)+ur*(ln(4.0::DOUBLE/3)-ln(0.75::DOUBLE))) AS r FROM q) SELECT width, height, round(avg(CASE WHEN floor(sqrt(area*r)+0.5) <= width AND floor(sqrt(area/r)+0.5) <= height THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END), 6) AS rate FROM z GROUP BY 1,2")
def fallback_rate(spark, d):
    import math

    g = meta(spark, d).select("width", "height").distinct().select("*", F.explode(F.sequence(F.lit(0), F.lit(199))).alias("k"))
    key = W() * 100000000 + H() * 10000 + F.col("k")
    area = W() * H() * between(0.5, 1.0, uniform("fall/s", key))
    r = F.exp(between(math.log(0.75), math.log(4 / 3), uniform("fall/r", key)))
    fits = (crops.whole(F.sqrt(area * r)) <= W()) & (crops.whole(F.sqrt(area / r)) <= H())
    return g.groupBy("width", "height").agg(F.round(F.avg(F.when(fits, 0.0).otherwise(1.0)), 6).alias("rate"))


@query()
def fallback_by_size(spark, d):
    return fallback.by_size(meta(spark, d))


@query()
def fallback_estimate(spark, d):
    return fallback.estimate(meta(spark, d))


@query(f"WITH {META}, c AS (SELECT _idx, {u('lam')} AS lam, CAST(floor({u('cut/y')}*200) AS BIGINT) AS cy, CAST(floor({u('cut/x')}*160) AS BIGINT) AS cx FROM m), q AS (SELECT *, CAST(floor(floor(200*sqrt(1-lam))/2) AS BIGINT) AS ch, CAST(floor(floor(160*sqrt(1-lam))/2) AS BIGINT) AS cw FROM c), b AS (SELECT _idx, least(greatest(cy-ch,0),200) AS yl, least(greatest(cy+ch,0),200) AS yh, least(greatest(cx-cw,0),160) AS xl, least(greatest(cx+cw,0),160) AS xh FROM q) SELECT *, round(1 - (yh-yl)*(xh-xl)/32000.0::DOUBLE, 6) AS kept FROM b")
def cutmix_bbox(spark, d):
    from prismframe.operators.mixup import kept_share

    box = crops.cutout(200, 160, uniform("lam", K()), F.floor(uniform("cut/y", K()) * 200), F.floor(uniform("cut/x", K()) * 160))
    return meta(spark, d).select("_idx", box.alias("b")).select("_idx", "b.*", half_up(kept_share(F.col("b"), 200, 160), 6).alias("kept"))


# --- hashes -------------------------------------------------------------------------


@query("SELECT doc_id AS _idx, substr(sha256(text),1,12) AS hash FROM documents")
def file_hash(spark, d):
    return blobs(spark, d).select("_idx", hashing.content_hash(F.col("text")).alias("hash"))


@query("SELECT source, substr(sha256(string_agg(line, chr(10) ORDER BY line)),1,12) AS hash FROM (SELECT source, doc_id || '.txt:' || (doc_id*7) || ':' || n_chars AS line FROM documents) GROUP BY 1")
def dir_hash(spark, d):
    files = table(spark, d, "documents").select("source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), (F.col("doc_id") * 7).alias("mtime"), F.col("n_chars").alias("size"))
    return hashing.listing_hash(files, ["source"])


@query("SELECT doc_id AS _idx, CASE WHEN doc_id % 3 = 0 THEN substr(md5(text),1,12) END AS hash FROM documents")
def hash_from_path(spark, d):
    path = F.concat(F.when(F.col("_idx") % 3 == 0, F.lit("/data/hashid/")).otherwise(F.lit("/data/other/")), F.substring(F.md5(F.col("text").cast("binary")), 1, 12), F.lit("/x.tar"))
    return blobs(spark, d).select("_idx", hashing.hash_in_path(path).alias("hash"))


@query("SELECT 'f' || doc_id AS name, 'download' AS action FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'f' || (doc_id + 1000000), 'upload' FROM labels WHERE doc_id % 5 = 0")
def sync_plan(spark, d):
    name = lambda c: F.concat(F.lit("f"), c.cast("string")).alias("name")
    remote = table(spark, d, "documents").select(name(F.col("doc_id")))
    lab = table(spark, d, "labels")
    return hashing.sync_plan(lab.select(name(F.col("doc_id"))).unionByName(lab.where("doc_id % 5 = 0").select(name(F.col("doc_id") + 1000000))), remote)


@query("SELECT p_partkey AS _idx, p_name AS name, CAST(p_size AS BIGINT) AS size, CAST(p_retailprice AS DOUBLE) AS price FROM part")
def chunked_items(spark, d):
    """part written as binary chunks of up to 100 items, and read back."""
    import struct

    import pyarrow as pa

    from prismframe.sources import chunked

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("p_partkey")
        items = [[n.encode(), struct.pack("<q", s), struct.pack("<d", p)] for n, s, p in zip(*(rows.column(c).to_pylist() for c in ("name", "size", "price")))]
        return pa.table({"content": pa.array([chunked.encode(items)], pa.binary()), "first": pa.array([rows.column("p_partkey")[0].as_py()], pa.int64())})

    part = table(spark, d, "part").select(F.col("p_partkey").cast("long"), F.floor(F.col("p_partkey") / 100).alias("k"), F.col("p_name").alias("name"), F.col("p_size").cast("long").alias("size"), F.col("p_retailprice").cast("double").alias("price"))
    chunks = part.groupBy("k").applyInArrow(pack, "content binary, first long")
    return chunked.unpacked(chunks, "content", "first", {"name": "str", "size": "int", "price": "float"})


@query(f"WITH {META}, r AS (SELECT _idx, CASE WHEN width<=height THEN 256 ELSE 256*width//height END AS width, CASE WHEN width<=height THEN 256*height//width ELSE 256 END AS height FROM m), c AS (SELECT *, least(width,512) AS out_width, least(height,512) AS out_height FROM r), s AS (SELECT *, (width-out_width)//2 AS hx, (height-out_height)//2 AS hy FROM c) SELECT _idx, CAST(width AS BIGINT) AS width, CAST(height AS BIGINT) AS height, CAST(hx + (width-out_width)%2*(hx%2) AS BIGINT) AS x, CAST(hy + (height-out_height)%2*(hy%2) AS BIGINT) AS y, CAST(out_width AS BIGINT) AS out_width, CAST(out_height AS BIGINT) AS out_height FROM s")
def prepare_short_long(spark, d):
    from prismframe.operators.prepare import short_long_size

    return meta(spark, d).select("_idx", short_long_size(W(), H()).alias("s")).select("_idx", "s.*")
