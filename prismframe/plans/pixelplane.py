"""Queries of the pixel plane on small derived images (3 x 4 x 4, from embeddings), a row for each value, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismframe.functions import imagebytes, pixels
from prismframe.functions.rng import between, chosen, uniform
from prismframe.operators import mixup, store
from prismframe.plans.metadata import ORACLES, QUERIES, query, table, u

HW, SIDE = 16, 4

P = "p AS (SELECT vec_id AS _idx, label, k, k//16 AS c, k%16 AS i, k%16//4 AS row, k%4 AS col, least(1.0::DOUBLE,greatest(0.0::DOUBLE,0.5::DOUBLE+2*embedding[k+1]::DOUBLE)) AS v FROM (SELECT *, unnest(range(48)) AS k FROM embeddings))"
RGB = P + ", rgb AS (SELECT _idx, i, max(CASE WHEN c=0 THEN v END) AS r, max(CASE WHEN c=1 THEN v END) AS g, max(CASE WHEN c=2 THEN v END) AS b FROM p GROUP BY 1,2)"
GRAY = RGB + ", gray AS (SELECT _idx, i, r*0.2989::DOUBLE + g*0.587::DOUBLE + b*0.114::DOUBLE AS l FROM rgb)"


def px(spark, d) -> DataFrame:
    e = F.transform(F.slice("embedding", 1, 48), lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(0.5) + 2 * x.cast("double"))))
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("_idx"), F.col("label").cast("long").alias("label"), e.alias("px"))


def values(df: DataFrame, out: Column, *keys: str) -> DataFrame:
    return df.select("_idx", *keys, F.posexplode(out).alias("k", "v")).select("_idx", *keys, F.col("k").cast("long").alias("k"), F.round("v", 5).alias("v"))


def pixel(name: str, sql: str, f) -> None:
    """A query that applies f to px, and its SQL: a FROM clause and an expression for v."""

    def run(spark, d):
        return values(px(spark, d), f(F.col("px")))

    run.__name__ = name
    QUERIES[name], ORACLES[name] = run, sql


def point(name: str, expr: str, f) -> None:
    pixel(name, f"WITH {P} SELECT _idx, k, round({expr}, 5) AS v FROM p", f)


def matrix(name: str, rows, f) -> None:
    """Colour matrices: rows of SQL terms over r, g, b."""
    parts = " UNION ALL ".join(f"SELECT _idx, {c * HW} + i AS k, round({e}, 5) AS v FROM rgb" for c, e in enumerate(rows))
    pixel(name, f"WITH {RGB} {parts}", f)


point("to_float_div", "v/255.0::DOUBLE", lambda p: pixels.divided(p, 255.0))
point("normalize", "(v - [0.485,0.456,0.406][c+1]::DOUBLE) / [0.229,0.224,0.225][c+1]::DOUBLE", lambda p: pixels.normalized(p, HW))
point("brightness", f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, v * (0.6::DOUBLE + {u('bright')} * {1.4 - 0.6!r}::DOUBLE)))", lambda p: pixels.brightness(p, between(0.6, 1.4, uniform("bright", "_idx"))))
point("solarize", f"CASE WHEN {u('sol')} < 0.5::DOUBLE AND v >= 0.5::DOUBLE THEN 1.0::DOUBLE - v ELSE v END", lambda p: F.when(chosen(0.5, "sol", "_idx"), pixels.solarize(p)).otherwise(p))
for _name, _src, _f in (
    ("hflip", "c*16 + row*4 + 3 - col", lambda p: pixels.hflip(p, SIDE, SIDE)),
    ("vflip", "c*16 + (3-row)*4 + col", lambda p: pixels.vflip(p, SIDE, SIDE)),
    ("channels_last", "i*3 + c", lambda p: pixels.channels_last(p, HW)),
    ("channels_first", "k%3*16 + k//3", lambda p: pixels.channels_first(p, HW)),
):
    pixel(_name, f"WITH {P} SELECT _idx, {_src} AS k, round(v, 5) AS v FROM p", _f)
pixel("random_hflip", f"WITH {P} SELECT _idx, CASE WHEN {u('flip')} < 0.5::DOUBLE THEN c*16 + row*4 + 3 - col ELSE k END AS k, round(v, 5) AS v FROM p", lambda p: F.when(chosen(0.5, "flip", "_idx"), pixels.hflip(p, SIDE, SIDE)).otherwise(p))
pixel("grayscale", f"WITH {GRAY} SELECT _idx, i AS k, round(l, 5) AS v FROM gray", lambda p: pixels.grayscale(p, HW))
pixel("random_grayscale", f"WITH {GRAY} SELECT _idx, k, round(CASE WHEN {u('gray')} < 0.5::DOUBLE THEN l ELSE v END, 5) AS v FROM p JOIN gray USING (_idx, i)", lambda p: F.when(chosen(0.5, "gray", "_idx"), pixels.grayscale(p, HW, 3)).otherwise(p))
_FACTOR = f"(0.6::DOUBLE + {u('con')} * {1.4 - 0.6!r}::DOUBLE)"
pixel("contrast", f"WITH {GRAY}, a AS (SELECT _idx, sum(l)/16 AS mean FROM gray GROUP BY 1) SELECT _idx, k, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, mean*(1-{_FACTOR}) + v*{_FACTOR})), 5) AS v FROM p JOIN a USING (_idx)", lambda p: pixels.contrast(p, HW, between(0.6, 1.4, uniform("con", "_idx"))))
_SAT = _FACTOR.replace("con", "sat")
pixel("saturation", f"WITH {GRAY} SELECT _idx, k, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, v*{_SAT} + l*(1-{_SAT}))), 5) AS v FROM p JOIN gray USING (_idx, i)", lambda p: pixels.saturation(p, HW, between(0.6, 1.4, uniform("sat", "_idx"))))
_LIN = "(CASE WHEN {0} > 0.04045::DOUBLE THEN pow(({0}+0.055::DOUBLE)/1.055::DOUBLE, 2.4::DOUBLE) ELSE {0}/12.92::DOUBLE END)"
point("srgb_to_linear", _LIN.format("v"), pixels.linear)


def _cone_rows() -> list[str]:
    import numpy as np

    m = np.array(pixels.CAT02) @ np.array(pixels.XYZ)
    return [" + ".join(f"{float(a)!r}::DOUBLE*{_LIN.format(x)}" for a, x in zip(row, "rgb")) for row in m]


matrix("srgb_to_lms", _cone_rows(), lambda p: pixels.cones(p, HW))


def _jitter_sql() -> list[str]:
    """One matrix: back from YIQ, times hue, saturation and value, times into YIQ; spelt out in SQL."""
    back, yiq = pixels.inverse(pixels.YIQ), pixels.YIQ
    h = f"radians({u('hue')} * 40 - 20)"
    s, v = f"(0.5::DOUBLE + {u('jsat')})", f"(0.8::DOUBLE + {u('jval')} * 0.4::DOUBLE)"
    y, i, q = ("(" + " + ".join(f"{a!r}::DOUBLE*{x}" for a, x in zip(row, "rgb")) + ")" for row in yiq)
    turned = [y, f"({s}*(cos({h})*{i} + sin({h})*{q}))", f"({s}*(cos({h})*{q} - sin({h})*{i}))"]
    return [f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, {v} * (" + " + ".join(f"{a!r}::DOUBLE*{t}" for a, t in zip(row, turned)) + ")))" for row in back]


matrix("jitter_hsv", _jitter_sql(), None)


def jitter_hsv(spark, d):
    m = pixels.bound(pixels.jitter_rows, uniform("hue", "_idx") * 40 - 20, F.lit(0.5) + uniform("jsat", "_idx"), F.lit(0.8) + uniform("jval", "_idx") * 0.4)
    # The matrix is a column of its own: worked out once a row, not once a pixel.
    df = px(spark, d).withColumn("m", m)
    return values(df, pixels.each(pixels.mixed(F.col("px"), HW, pixels.held(F.col("m"))), pixels.clamp))


QUERIES["jitter_hsv"] = jitter_hsv

_BOX = f"b AS (SELECT vec_id AS _idx, 1 + CAST(floor({u('er/w', 'vec_id')}*3) AS BIGINT) AS bw, 1 + CAST(floor({u('er/h', 'vec_id')}*3) AS BIGINT) AS bh, {u('er/x', 'vec_id')} AS ux, {u('er/y', 'vec_id')} AS uy FROM embeddings), r AS (SELECT _idx, bw, bh, CAST(floor(ux*(5-bw)) AS BIGINT) AS bx, CAST(floor(uy*(5-bh)) AS BIGINT) AS byy FROM b)"
_IN = "col>=bx AND col<bx+bw AND row>=byy AND row<byy+bh"


def _box() -> tuple[Column, ...]:
    w, h = 1 + F.floor(uniform("er/w", "_idx") * 3), 1 + F.floor(uniform("er/h", "_idx") * 3)
    return F.floor(uniform("er/x", "_idx") * (5 - w)), F.floor(uniform("er/y", "_idx") * (5 - h)), w, h


pixel("erase_zeros", f"WITH {P}, {_BOX} SELECT _idx, k, round(CASE WHEN {_IN} THEN 0 ELSE v END, 5) AS v FROM p JOIN r USING (_idx)", lambda p: pixels.where_inside(p, SIDE, SIDE, *_box(), lambda c, x: F.lit(0.0)))
pixel("erase_color", f"WITH {P}, {_BOX} SELECT _idx, k, round(CASE WHEN {_IN} THEN " + u("('er/c' || c)") + " ELSE v END, 5) AS v FROM p JOIN r USING (_idx)", lambda p: pixels.where_inside(p, SIDE, SIDE, *_box(), lambda c, x: uniform(F.concat(F.lit("er/c"), c.cast("string")), "_idx")))
for _mode, _r in (("edge", "least(greatest({0},0),3)"), ("reflect", "3-abs(3-abs({0}))"), ("symmetric", "(CASE WHEN (CASE WHEN {0}<0 THEN -{0}-1 ELSE {0} END)>=4 THEN 7-(CASE WHEN {0}<0 THEN -{0}-1 ELSE {0} END) ELSE (CASE WHEN {0}<0 THEN -{0}-1 ELSE {0} END) END)")):
    pixel(f"pad_{_mode}", f"WITH {P}, t AS (SELECT _idx, unnest(range(105)) AS k FROM embeddings JOIN (SELECT vec_id AS _idx FROM embeddings) e ON e._idx = vec_id), q AS (SELECT _idx, k, k//35 AS c, {_r.format('(k%35//7-1)')} AS row, {_r.format('(k%7-2)')} AS col FROM t) SELECT q._idx, q.k, round(p.v, 5) AS v FROM q JOIN p ON p._idx=q._idx AND p.c=q.c AND p.row=q.row AND p.col=q.col", lambda p, m=_mode: pixels.padded(p, SIDE, SIDE, 2, 1, 1, 0, m))
pixel("pad_crop", f"WITH {P}, t AS (SELECT vec_id AS _idx, unnest(range(108)) AS k FROM embeddings), q AS (SELECT _idx, k, k//36 AS c, k%36//6-1 AS row, k%6-1 AS col FROM t) SELECT q._idx, q.k, round(coalesce(p.v, 0.25::DOUBLE), 5) AS v FROM q LEFT JOIN p ON p._idx=q._idx AND p.c=q.c AND p.row=q.row AND p.col=q.col", lambda p: pixels.padded(p, SIDE, SIDE, 1, 1, 1, 1, "constant", 0.25))


@query("SELECT vec_id AS _idx, k, CASE WHEN k = label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM (SELECT *, unnest(range(10)) AS k FROM embeddings)")
def one_hot(spark, d):
    return values(px(spark, d), pixels.one_hot(F.col("label"), 10))


PAIR = P + f", o AS (SELECT vec_id, label, (row_number() OVER (ORDER BY vec_id) - 1) AS pos FROM embeddings), a AS (SELECT vec_id AS _idx, CAST(label AS BIGINT) AS label, pos//50 AS batch, pos%50 AS slot FROM o WHERE pos//50 < (SELECT count(*) FROM embeddings)//50), w AS (SELECT a._idx, a.label, b._idx AS other, b.label AS other_label, {u('lam', 'a._idx')} AS lam FROM a JOIN a b ON a.batch=b.batch AND b.slot=49-a.slot)"


def _pairs(spark, d) -> DataFrame:
    from prismframe.operators.loader import Loader

    return mixup.paired(Loader(px(spark, d), 50, shuffle=False).plan(), 50, ["px", "label"]).withColumn("lam", uniform("lam", "_idx"))


@query(f"WITH {PAIR} SELECT w._idx, p.k, round(p.v*lam + q.v*(1-lam), 5) AS v FROM w JOIN p ON p._idx=w._idx JOIN p q ON q._idx=w.other AND q.k=p.k")
def mixup_pixels(spark, d):
    return values(_pairs(spark, d), mixup.mixed_pixels(F.col("px"), F.col("other_px"), F.col("lam")))


@query(f"WITH {PAIR} SELECT _idx, k, round((CASE WHEN k=label THEN 0.91::DOUBLE ELSE 0.01::DOUBLE END)*lam + (CASE WHEN k=other_label THEN 0.91::DOUBLE ELSE 0.01::DOUBLE END)*(1-lam), 5) AS v FROM (SELECT *, unnest(range(10)) AS k FROM w)")
def mixup_target(spark, d):
    return values(_pairs(spark, d), mixup.target(F.col("label"), F.col("other_label"), 10, F.col("lam"), 0.1))


@query(f"WITH {P} SELECT c AS channel, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM p GROUP BY 1")
def norm_stats(spark, d):
    return store.normalization(px(spark, d), "px", HW).select("channel", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(f"WITH {P} SELECT c AS channel, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM p WHERE _idx < 100 GROUP BY 1")
def norm_stats_limit(spark, d):
    return store.normalization(px(spark, d), "px", HW, 100).select("channel", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def _headers(spark, d) -> DataFrame:
    """PNG, GIF, BMP, JPEG-like and other heads made from image sizes."""
    from prismframe.plans.metadata import meta

    be = lambda c, n: F.lpad(F.hex(c), 2 * n, "0")
    le = lambda c, n: F.concat(*[F.lpad(F.hex(F.pmod(F.shiftright(c, 8 * k), F.lit(256))), 2, "0") for k in range(n)])
    w, h = F.col("width"), F.col("height")
    kind = F.col("_idx") % 5
    text = F.when(kind == 0, F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), be(w, 4), be(h, 4), F.lit("0000"))).when(kind == 1, F.concat(F.lit("474946383961"), le(w, 2), le(h, 2), F.lit("00" * 20))).when(kind == 2, F.concat(F.lit("424D" + "00" * 16), le(w, 4), le(-h, 4), F.lit("0000"))).when(kind == 3, F.concat(F.lit("FFD8FFC0001108"), be(h, 2), be(w, 2), F.lit("00" * 20))).otherwise(F.lit("00" * 30))
    return meta(spark, d).select("_idx", F.unhex(text).alias("data"))


@query("SELECT p_partkey AS _idx, CASE p_partkey%5 WHEN 0 THEN 'png' WHEN 3 THEN 'jpeg' ELSE 'other' END AS format FROM part")
def detect_format(spark, d):
    return _headers(spark, d).select("_idx", imagebytes.image_format(F.col("data")).alias("format"))


@query("WITH m AS (SELECT p_partkey AS _idx, 64 + p_partkey*37%577 AS width, 64 + (p_partkey*53+11)%449 AS height FROM part) SELECT _idx, CASE WHEN _idx%5=4 THEN 0 ELSE width END AS width, CASE WHEN _idx%5=4 THEN 0 ELSE height END AS height FROM m")
def image_dims(spark, d):
    return _headers(spark, d).select("_idx", imagebytes.image_size(F.col("data")).alias("s")).select("_idx", "s.width", "s.height")


@query("WITH t AS (SELECT p_partkey AS _idx, p_partkey*7%256 AS y, p_partkey*11%256-128 AS u, p_partkey*13%256-128 AS v FROM part), q AS (SELECT _idx, y + ((91881*v+32768)>>16) AS r, y + ((-22554*u-46802*v+32768)>>16) AS g, y + ((116130*u+32768)>>16) AS b FROM t) SELECT _idx, CAST(least(greatest(r,0),255) AS BIGINT) AS r, CAST(least(greatest(g,0),255) AS BIGINT) AS g, CAST(least(greatest(b,0),255) AS BIGINT) AS b FROM q")
def yuv_to_rgb_table(spark, d):
    i = F.col("p_partkey")
    return spark.read.parquet(f"{d}/part.parquet").select(i.alias("_idx"), imagebytes.yuv_to_rgb(i * 7 % 256, i * 11 % 256, i * 13 % 256).alias("c")).select("_idx", "c.*")


@query("SELECT p_partkey AS _idx, " + ", ".join(" || ".join(f"lpad(to_hex(p_partkey*{2 * k + 3}%256), 2, '0')" for k in ks) + f" AS {n}" for n, ks in (("y", range(8)), ("u", (8, 9)), ("v", (10, 11)))) + " FROM part")
def yuv_planes_table(spark, d):
    """All bytes of the planes of an image of 4 x 2 for each row of part."""
    i = F.col("p_partkey")
    data = F.unhex(F.concat(*[F.lpad(F.hex(i * (2 * k + 3) % 256), 2, "0") for k in range(12)]))
    p = imagebytes.yuv_planes(data, F.lit(4), F.lit(2))
    return spark.read.parquet(f"{d}/part.parquet").select(i.alias("_idx"), p.alias("p")).select("_idx", *[F.hex(F.col(f"p.{c}")).alias(c) for c in "yuv"])


# --- hue, saturation, value; JPEG; mixing; warps drawn for each row --------------------

_TOP, _LOW = "greatest(r,g,b)", "least(r,g,b)"
_SPREAD = f"(CASE WHEN {_TOP}={_LOW} THEN 1.0::DOUBLE ELSE {_TOP}-{_LOW} END)"
_HUE = f"fmod((CASE WHEN {_TOP}=r THEN ({_TOP}-b)/{_SPREAD} - ({_TOP}-g)/{_SPREAD} WHEN {_TOP}=g THEN 2.0::DOUBLE + ({_TOP}-r)/{_SPREAD} - ({_TOP}-b)/{_SPREAD} ELSE 4.0::DOUBLE + ({_TOP}-g)/{_SPREAD} - ({_TOP}-r)/{_SPREAD} END)/6 + 1.0::DOUBLE, 1.0::DOUBLE)"
_SATURATION = f"(({_TOP}-{_LOW}) / (CASE WHEN {_TOP}={_LOW} THEN 1.0::DOUBLE ELSE {_TOP} END))"
matrix("rgb_to_hsv", [_HUE, _SATURATION, _TOP], lambda p: pixels.to_hsv(p, HW))


def _hue_sql(source: str, shift: str) -> str:
    """r, g, b of the CTE `source` with their hue moved, as a chain of CTEs that ends in `done`."""
    clip = lambda e: f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, {e}))"
    pick = lambda *xs: "CASE i6 " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(xs)) + " END"
    return (
        f"hsv AS (SELECT _idx, i, fmod({_HUE} + {shift}, 1.0::DOUBLE) AS h, {_SATURATION} AS s, {_TOP} AS v FROM {source}), "
        "sect AS (SELECT *, ((CAST(floor(h*6) AS BIGINT) % 6) + 6) % 6 AS i6, h*6 - floor(h*6) AS f FROM hsv), "
        f"pqt AS (SELECT *, {clip('v*(1-s)')} AS p, {clip('v*(1-s*f)')} AS q, {clip('v*(1-s*(1-f))')} AS t FROM sect), "
        f"done AS (SELECT _idx, i, {pick(*'vqpptv')} AS r, {pick(*'tvvqpp')} AS g, {pick(*'pptvvq')} AS b FROM pqt)"
    )


_UNPACK = " UNION ALL ".join(f"SELECT _idx, {c * HW} + i AS k, round({x}, 5) AS v FROM done" for c, x in enumerate("rgb"))
pixel("hue_shift", f"WITH {RGB}, {_hue_sql('rgb', f'({u('hshift')} - 0.5::DOUBLE)')} {_UNPACK}", lambda p: pixels.hue_shifted(p, HW, uniform("hshift", "_idx") - 0.5))

_CJ = lambda name: f"(0.6::DOUBLE + {u(name)} * {1.4 - 0.6!r}::DOUBLE)"
_CLIP = lambda e: f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, {e}))"
_GRAY3 = "(r*0.2989::DOUBLE + g*0.587::DOUBLE + b*0.114::DOUBLE)"
_JITTERED = (
    f"WITH {RGB}, j1 AS (SELECT _idx, i, " + ", ".join(f"{_CLIP(f'{x}*{_CJ("cj/b")}')} AS {x}" for x in "rgb") + " FROM rgb), "
    f"j2 AS (SELECT *, avg({_GRAY3}) OVER (PARTITION BY _idx) AS mean FROM j1), "
    "j3 AS (SELECT _idx, i, " + ", ".join(f"{_CLIP(f'mean*(1-{_CJ("cj/c")}) + {x}*{_CJ("cj/c")}')} AS {x}" for x in "rgb") + " FROM j2), "
    "j4 AS (SELECT _idx, i, " + ", ".join(f"{_CLIP(f'{x}*{_CJ("cj/s")} + {_GRAY3}*(1-{_CJ("cj/s")})')} AS {x}" for x in "rgb") + " FROM j3), "
    + _hue_sql("j4", f"({u('cj/h')} * 0.2::DOUBLE - 0.1::DOUBLE)") + " " + _UNPACK
)


@query(_JITTERED)
def color_jitter(spark, d):
    factor = lambda s: between(0.6, 1.4, uniform(s, "_idx"))
    return values(px(spark, d), pixels.colour_jitter(F.col("px"), HW, uniform("cj/h", "_idx") * 0.2 - 0.1, factor("cj/s"), factor("cj/b"), factor("cj/c")))


def _twist_sql() -> list[str]:
    b, c = "(0.8::DOUBLE + " + u("tw/b") + " * 0.4::DOUBLE)", "(0.5::DOUBLE + " + u("tw/c") + ")"
    inner = [e.removeprefix("least(1.0::DOUBLE, greatest(0.0::DOUBLE, ").removesuffix("))") for e in _jitter_sql()]
    return [f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, ({e})*({b}*{c}) + (0.5::DOUBLE - 0.5::DOUBLE*{c})*{b}))" for e in inner]


matrix("jitter_twist", _twist_sql(), None)


def jitter_twist(spark, d):
    m = pixels.bound(pixels.jitter_rows, uniform("hue", "_idx") * 40 - 20, F.lit(0.5) + uniform("jsat", "_idx"), F.lit(0.8) + uniform("jval", "_idx") * 0.4)
    df = px(spark, d).withColumn("m", m).withColumn("b", F.lit(0.8) + uniform("tw/b", "_idx") * 0.4).withColumn("c", F.lit(0.5) + uniform("tw/c", "_idx"))
    return values(df, pixels.twisted(F.col("px"), HW, pixels.held(F.col("m")), F.col("b"), F.col("c")))


QUERIES["jitter_twist"] = jitter_twist


_SIZES = "m AS (SELECT p_partkey AS _idx, 64 + p_partkey*37%577 AS width, 64 + (p_partkey*53+11)%449 AS height, p_partkey*29%256 AS v FROM part)"


@query(f"WITH {_SIZES} SELECT _idx, 'jpeg' AS format, 1 + width%40 AS width, 1 + height%30 AS height, v AS least, v AS most, v*3*(1 + width%40)*(1 + height%30) AS total FROM m")
def decode_jpeg_solid(spark, d):
    """JPEG bytes of one gray each, decoded in batches: size, least, greatest and sum of the bytes."""
    import numpy as np
    import pyarrow as pa

    from prismframe.operators import jpeg, kernels, stages
    from prismframe.plans.metadata import meta

    rows = meta(spark, d).select("_idx", (1 + F.col("width") % 40).alias("w"), (1 + F.col("height") % 30).alias("h"), (F.col("_idx") * 29 % 256).alias("v"))

    def make(batches):
        for b in batches:
            data = [jpeg.encode(np.full((h, w, 3), v, np.uint8)) for w, h, v in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], ["_idx", "image"])

    def decode(batches):
        for b in batches:
            images = kernels.decode_all(b.column(1).to_pylist(), [0] * b.num_rows, [0] * b.num_rows)
            got = [(x.shape[1], x.shape[0], int(x.min()), int(x.max()), int(x.sum(dtype=np.int64))) for x in images]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(pa.array(c, pa.int64()) for c in zip(*got))], ["_idx", "format", "width", "height", "least", "most", "total"])

    encoded = stages.dealt(rows).mapInArrow(make, "_idx long, image binary").withColumn("format", imagebytes.image_format(F.col("image")))
    return encoded.mapInArrow(decode, "_idx long, format string, width long, height long, least long, most long, total long")


def _gray_pngs(spark, d) -> DataFrame:
    import numpy as np
    import pyarrow as pa

    from prismframe.operators import kernels, stages
    from prismframe.plans.metadata import meta

    def make(batches):
        for b in batches:
            data = [kernels.encode_png(np.full((h, w, 3), v, np.uint8)) for w, h, v in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], ["_idx", "image"])

    rows = meta(spark, d).select("_idx", (1 + F.col("width") % 40).alias("w"), (1 + F.col("height") % 30).alias("h"), (F.col("_idx") * 29 % 256).alias("v"))
    return stages.dealt(rows).mapInArrow(make, "_idx long, image binary")


_GRAYS = f"WITH {_SIZES}, g AS (SELECT _idx, 1 + width%40 AS w, 1 + height%30 AS h, v FROM m)"


@query(f"{_GRAYS} SELECT _idx, h + h%2 AS height, w + w%2 AS width, (h + h%2)*(w + w%2)*3//2 AS size, repeat('80', CAST((h + h%2)*(w + w%2)//2 AS INTEGER)) AS chroma FROM g")
def images_to_yuv420(spark, d):
    """PNGs of one gray each as planar YUV: even sizes, and neutral chroma planes in hex."""
    from prismframe.operators.prepare import to_yuv420

    luma = (F.col("height") * F.col("width")).cast("int")
    return to_yuv420()(_gray_pngs(spark, d)).select("_idx", "height", "width", F.octet_length("image").cast("long").alias("size"), F.hex(F.substring("image", luma + 1, luma)).alias("chroma"))


@query(f"{_GRAYS}, r AS (SELECT _idx, v, CASE WHEN w<=h THEN 16 ELSE 16*w//h END AS w, CASE WHEN w<=h THEN 16*h//w ELSE 16 END AS h FROM g) SELECT _idx, CAST(least(w,32) AS BIGINT) AS width, CAST(least(h,32) AS BIGINT) AS height, v AS least, v AS most FROM r")
def prepare_images(spark, d):
    """PNGs of one gray each, short edge to 16, long edge cut to 32: size, least and greatest byte."""
    import pyarrow as pa

    from prismframe.operators import kernels, prepare

    def look(batches):
        for b in batches:
            images = kernels.decode_all(b.column(1).to_pylist(), [0] * b.num_rows, [0] * b.num_rows)
            got = [(x.shape[1], x.shape[0], int(x.min()), int(x.max())) for x in images]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([g[k] for g in got], pa.int64()) for k in range(4))], ["_idx", "width", "height", "least", "most"])

    return prepare.short_long(16, 32)(_gray_pngs(spark, d)).mapInArrow(look, "_idx long, width long, height long, least long, most long")


_MIX = (
    f"WITH {PAIR}, d1 AS (SELECT *, {u('mix/do')} < 0.8::DOUBLE AS does, {u('mix/switch')} < 0.5::DOUBLE AS cuts, {u('mix/cut')} AS lc, {u('mix/lam')} AS lm, CAST(floor({u('mix/cy')}*4) AS BIGINT) AS cy, CAST(floor({u('mix/cx')}*4) AS BIGINT) AS cx FROM w), "
    "d2 AS (SELECT _idx, other, label, other_label, cy, cx, does AND cuts AS cut, CASE WHEN NOT does THEN 1.0::DOUBLE WHEN cuts THEN lc ELSE lm END AS l0 FROM d1), "
    "d3 AS (SELECT *, CAST(floor(floor(4*sqrt(1-l0))/2) AS BIGINT) AS half FROM d2), "
    "d4 AS (SELECT *, least(greatest(cy-half,0),4) AS yl, least(greatest(cy+half,0),4) AS yh, least(greatest(cx-half,0),4) AS xl, least(greatest(cx+half,0),4) AS xh FROM d3), "
    "d5 AS (SELECT *, CASE WHEN cut THEN 1 - (yh-yl)*(xh-xl)/16.0::DOUBLE ELSE l0 END AS l1 FROM d4) "
)


def _mixed(spark, d) -> DataFrame:
    from prismframe.operators.loader import Loader

    return mixup.mix(Loader(px(spark, d), 50, shuffle=False).plan(), 50, SIDE, SIDE, 10, smoothing=0.1, mixup_alpha=1.0, cutmix_alpha=1.0, prob=0.8)


@query(_MIX + "SELECT e._idx, p.k, round(CASE WHEN cut THEN CASE WHEN p.row>=yl AND p.row<yh AND p.col>=xl AND p.col<xh THEN q.v ELSE p.v END ELSE p.v*l1 + q.v*(1-l1) END, 5) AS v FROM d5 e JOIN p ON p._idx=e._idx JOIN p q ON q._idx=e.other AND q.k=p.k")
def mixup_cutmix_pixels(spark, d):
    return values(_mixed(spark, d), F.col("px"))


@query(_MIX + "SELECT _idx, k, round((CASE WHEN k=label THEN 0.91::DOUBLE ELSE 0.01::DOUBLE END)*l1 + (CASE WHEN k=other_label THEN 0.91::DOUBLE ELSE 0.01::DOUBLE END)*(1-l1), 5) AS v FROM (SELECT *, unnest(range(10)) AS k FROM d5)")
def mixup_cutmix_target(spark, d):
    return values(_mixed(spark, d), F.col("label"))


@query(f"WITH t AS (SELECT p_partkey AS _idx FROM part), b AS (SELECT _idx, 40 + CAST(floor({u('mm/h')}*80) AS BIGINT) AS h, 32 + CAST(floor({u('mm/w')}*64) AS BIGINT) AS w FROM t), q AS (SELECT _idx, h, w, CAST(floor({u('mm/y')}*(200-h)) AS BIGINT) AS yl, CAST(floor({u('mm/x')}*(160-w)) AS BIGINT) AS xl FROM b) SELECT _idx, yl, yl+h AS yh, xl, xl+w AS xh FROM q")
def cutmix_bbox_minmax(spark, d):
    from prismframe.functions import crops
    from prismframe.plans.metadata import meta

    box = crops.cutout_between(200, 160, (0.2, 0.6), *(uniform(f"mm/{c}", "_idx") for c in "hwyx"))
    return meta(spark, d).select("_idx", box.alias("b")).select("_idx", "b.*")


def _sampled_sql(params: str, m: list[str], mode: str, p: str) -> str:
    """Bilinear samples of the small images through a matrix: params: columns of a CTE over t(_idx); m: its entries."""
    a, b, c, d_, e, f = m
    folded = {"zeros": ("{0}", " AND q.{0} >= 0 AND q.{0} < 4"), "border": ("least(greatest({0},0),3)", "")}[mode]
    place = {"zeros": "(({0}+1)*4-1)/2", "border": "least(3.0::DOUBLE, greatest(0.0::DOUBLE, (({0}+1)*4-1)/2))"}[mode]
    taps = " UNION ALL ".join(
        f"SELECT _idx, i, x0+{dx} AS xi, y0+{dy} AS yi, {'x-x0' if dx else '1-x+x0'} AS wx, {'y-y0' if dy else '1-y+y0'} AS wy FROM pt" for dx in (0, 1) for dy in (0, 1)
    )
    return (
        f"WITH {P}, t AS (SELECT vec_id AS _idx FROM embeddings), par AS (SELECT _idx, {p} AS does, {params} FROM t), grid AS (SELECT *, unnest(range(16)) AS i FROM par), "
        "xy AS (SELECT *, (i%4*2+1)/4.0::DOUBLE - 1 AS gx, (i//4*2+1)/4.0::DOUBLE - 1 AS gy FROM grid), "
        f"seen AS (SELECT _idx, i, CASE WHEN does THEN {a}*gx + {b}*gy + {c} ELSE gx END AS sx, CASE WHEN does THEN {d_}*gx + {e}*gy + {f} ELSE gy END AS sy FROM xy), "
        f"pos AS (SELECT _idx, i, {place.format('sx')} AS x, {place.format('sy')} AS y FROM seen), pt AS (SELECT *, CAST(floor(x) AS BIGINT) AS x0, CAST(floor(y) AS BIGINT) AS y0 FROM pos), "
        f"q AS ({taps}), ch AS (SELECT *, unnest(range(3)) AS c FROM q) "
        f"SELECT q._idx, q.c*16 + q.i AS k, round(sum(coalesce(p.v, 0)*wx*wy), 5) AS v FROM ch q LEFT JOIN p ON p._idx = q._idx AND p.c = q.c AND p.row = {folded[0].format('yi')} AND p.col = {folded[0].format('xi')} GROUP BY 1, 2"
    )


def _stage_query(name: str, sql: str, step) -> None:
    def run(spark, d):
        return values(step()(px(spark, d)), F.col("px"))

    run.__name__ = name
    QUERIES[name], ORACLES[name] = run, sql


def _warps() -> None:
    from prismframe.operators import stages

    shape, half = (3, SIDE, SIDE), "0.5::DOUBLE"
    deg = lambda s, most: f"radians(-({-most}::DOUBLE + {u(s)} * {2 * most}::DOUBLE))"
    turn = ["cos(d)", "sin(d)", "x-cos(d)*x-sin(d)*y", "-sin(d)", "cos(d)", "y+sin(d)*x-cos(d)*y"]
    point = lambda s: f"({u(s + '/x')}*2-1) AS x, ({u(s + '/y')}*2-1) AS y"
    _stage_query("random_rotate", _sampled_sql(f"{deg('rotate/deg', 45)} AS d, {point('rotate')}", turn, "zeros", f"{u('rotate')} < {half}"), lambda: stages.random_rotate("px", shape, 0.5, 45, (0.0, 1.0), (0.0, 1.0)))
    _stage_query("random_zoom", _sampled_sql(f"({half} + {u('zoom/z')}*{half}) AS z, {point('zoom')}", ["z", "0", "(1-z)*x", "0", "z", "(1-z)*y"], "zeros", f"{u('zoom')} < {half}"), lambda: stages.random_zoom("px", shape, 0.5, (0.5, 1.0), (0.0, 1.0), (0.0, 1.0)))
    moved = f"{deg('object/deg', 45)} AS d, (1.0::DOUBLE + {u('object/z')}) AS z, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, ({half} - (0.25::DOUBLE + {u('object/tx')}*{half}))*2 AS sx, ({half} - (0.25::DOUBLE + {u('object/ty')}*{half}))*2 AS sy"
    _stage_query("random_rotate_object", _sampled_sql(moved, ["z*cos(d)", "z*sin(d)", "(z*cos(d)*sx + z*sin(d)*sy)", "-z*sin(d)", "z*cos(d)", "(-z*sin(d)*sx + z*cos(d)*sy)"], "border", f"{u('object')} < {half}"), lambda: stages.random_rotate_object("px", shape))
    tile = "(row//2*2 + col//2)"
    orders = f"ord AS (SELECT _idx, t, row_number() OVER (PARTITION BY _idx ORDER BY {u("('patches/0/' || t)")}, t) - 1 AS to_tile, {u('patches')} < {half} AS does FROM (SELECT vec_id AS _idx, unnest(range(4)) AS t FROM embeddings))"
    _stage_query("random_patch_shuffle", f"WITH {P}, {orders} SELECT p._idx, CASE WHEN does THEN c*16 + (to_tile//2*2 + row%2)*4 + to_tile%2*2 + col%2 ELSE k END AS k, round(v, 5) AS v FROM p JOIN ord ON ord._idx = p._idx AND ord.t = {tile}", lambda: stages.random_patch_shuffle("px", shape, [0.5]))
    place = f"pl AS (SELECT vec_id AS _idx, CAST(floor({u('embed/x', 'vec_id')}*4) AS BIGINT) AS x0, CAST(floor({u('embed/y', 'vec_id')}*4) AS BIGINT) AS y0 FROM embeddings)"
    cells = "cell AS (SELECT _idx, x0, y0, k, k//64 AS c, k%64//8 AS row, k%8 AS col FROM (SELECT *, unnest(range(192)) AS k FROM pl))"
    _stage_query("random_embed", f"WITH {P}, {place}, {cells} SELECT cell._idx, cell.k, round(coalesce(p.v, [0.1, 0.2, 0.3][cell.c+1]::DOUBLE), 5) AS v FROM cell LEFT JOIN p ON p._idx = cell._idx AND p.c = cell.c AND p.row = cell.row - y0 AND p.col = cell.col - x0", lambda: stages.random_embed("px", shape, 8, (0.0, 1.0), (0.0, 1.0), "constant", (0.1, 0.2, 0.3)))


_warps()


@query(f"WITH {P} SELECT _idx, k, round(v*v + (1-v)*[0.1, 0.2, 0.3][c+1]::DOUBLE, 5) AS v FROM p")
def background_blend(spark, d):
    """Each image with itself as alpha, over one colour: alpha is a channel, so the three are blended one by one."""
    from prismframe.operators import stages

    df = px(spark, d)
    out = None
    for c, fill in enumerate((0.1, 0.2, 0.3)):
        one = pixels.channel(F.col("px"), c, HW)
        rows = df.select("_idx", F.concat(one, one, one, one).alias("px"))
        rows = stages.background_blend("px", SIDE, "constant", (fill,) * 3)(rows).select("_idx", F.lit(c).alias("c"), F.posexplode(F.slice("px", 1, HW)).alias("i", "v"))
        out = rows if out is None else out.unionByName(rows)
    return out.select("_idx", (F.col("c") * HW + F.col("i")).cast("long").alias("k"), F.round("v", 5).alias("v"))


_DEG, _X, _Y, _Z = f"radians(45-{u('deg')}*90)", f"({u('cx')}*2-1)", f"({u('cy')}*2-1)", f"(0.5::DOUBLE+{u('zoom')})"
_ROT = ["cos(d)", "sin(d)", "x-cos(d)*x-sin(d)*y", "-sin(d)", "cos(d)", "y+sin(d)*x-cos(d)*y", "0", "0", "1"]


@query(f"WITH t AS (SELECT vec_id AS _idx FROM embeddings), q AS (SELECT _idx, {_DEG} AS d, {_X} AS x, {_Y} AS y FROM t) " + " UNION ALL ".join(f"SELECT _idx, {k} AS k, round(({e})::DOUBLE, 5) AS v FROM q" for k, e in enumerate(_ROT)))
def rotate_matrix(spark, d):
    m = pixels.bound(pixels.rotate_rows, uniform("deg", "_idx") * 90 - 45, uniform("cx", "_idx"), uniform("cy", "_idx"))
    return values(px(spark, d), m)


@query(f"WITH t AS (SELECT vec_id AS _idx FROM embeddings), q AS (SELECT _idx, {_Z} AS z, {_X} AS x, {_Y} AS y FROM t) " + " UNION ALL ".join(f"SELECT _idx, {k} AS k, round(({e})::DOUBLE, 5) AS v FROM q" for k, e in enumerate(["z", "0", "(1-z)*x", "0", "z", "(1-z)*y", "0", "0", "1"])))
def zoom_matrix(spark, d):
    return values(px(spark, d), pixels.bound(pixels.zoom_rows, F.lit(0.5) + uniform("zoom", "_idx"), uniform("cx", "_idx"), uniform("cy", "_idx")))


@query(f"WITH t AS (SELECT vec_id AS _idx FROM embeddings), q AS (SELECT _idx, {_DEG} AS d, {_X} AS x, {_Y} AS y, {_Z} AS z, ({u('cx')}-{u('tx')})*2 AS sx, ({u('cy')}-{u('ty')})*2 AS sy FROM t), m AS (SELECT *, z*cos(d) AS a, z*sin(d) AS b, cos(d)*(1-z)*x + sin(d)*(1-z)*y + x-cos(d)*x-sin(d)*y AS c, -sin(d)*(1-z)*x + cos(d)*(1-z)*y + y+sin(d)*x-cos(d)*y AS f FROM q) " + " UNION ALL ".join(f"SELECT _idx, {k} AS k, round(({e})::DOUBLE, 5) AS v FROM m" for k, e in enumerate(["a", "b", "a*sx+b*sy+c", "-b", "a", "-b*sx+a*sy+f", "0", "0", "1"])))
def rotate_object_matrix(spark, d):
    draw = lambda s: uniform(s, "_idx")
    matrix = pixels.bound(pixels.rotate_object_rows, draw("deg") * 90 - 45, draw("cx"), draw("cy"), F.lit(0.5) + draw("zoom"), draw("tx"), draw("ty"))
    return values(px(spark, d), matrix)


@query()
def stage_resize_crop_png(spark, d):
    """Decoded, cropped and resized images of PNG bytes that are made from sizes: rows only."""
    from prismframe.operators import stages

    rows = _png_rows(spark, d)
    return stages.resize_crop(32, 28)(rows).select("_idx", "view_rect.x", "view_rect.y", "view_rect.w", "view_rect.h", F.sha2("view", 256).alias("pixels"))


def _kernel_query(name: str, f) -> None:
    """f over the small images, values rounded: rows only; tests hold the kernels against closed forms."""

    def run(spark, d):
        from prismframe.operators.stages import pixel_kernel

        return pixel_kernel("px", (3, SIDE, SIDE), f)(px(spark, d)).select("_idx", F.posexplode("px").alias("k", "v")).select("_idx", F.col("k").cast("long").alias("k"), F.round("v", 5).alias("v"))

    run.__name__ = name
    QUERIES[name] = run


def _kernels() -> None:
    import numpy as np

    from prismframe.operators import kernels as n

    turn = lambda a: np.array([[np.cos(a), np.sin(a), 0], [-np.sin(a), np.cos(a), 0], [0, 0, 1.0]])
    _kernel_query("kernel_blur", lambda p: n.convolve(p, n.gaussian(3, 1.0), "reflect"))
    _kernel_query("kernel_rotate", lambda p: n.affine(p, turn(0.5)))
    _kernel_query("kernel_zoom", lambda p: n.affine(p, np.diag([0.5, 0.5, 1.0])))
    _kernel_query("kernel_rotate_object", lambda p: n.affine(p, turn(0.3) @ np.diag([1.5, 1.5, 1.0]), "border"))
    _kernel_query("kernel_distortion", lambda p: n.distort(p))
    _kernel_query("kernel_lgn", lambda p: n.lgn(p))
    _kernel_query("kernel_patch_shuffle", lambda p: n.patch_shuffle(p, 2, np.array([3, 1, 0, 2])))
    _kernel_query("kernel_circle_mask", lambda p: p * n.circle_mask(SIDE, 1.0))
    _kernel_query("kernel_noise_embed", lambda p: n.embed(p, n.power_noise(8, 8, channels=3, low=0.0, high=1.0), 3, -1))


_kernels()


@query()
def preset_simclr(spark, d):
    """The symmetric two-view preset on small PNGs: rows only."""
    from functools import reduce

    from prismframe.plans import presets

    out = reduce(lambda x, f: f(x), presets.simclr_symmetric(8, 1), _png_rows(spark, d))
    return out.select("_idx", F.round(F.aggregate("view_0_px", F.lit(0.0), lambda a, x: a + x), 3).alias("sum_0"), F.round(F.aggregate("view_1_px", F.lit(0.0), lambda a, x: a + x), 3).alias("sum_1"))


def _png_rows(spark, d) -> DataFrame:
    from prismframe.operators.stages import dealt
    from prismframe.plans.metadata import meta

    def make(batches):
        import numpy as np
        import pyarrow as pa

        from prismframe.operators.kernels import encode_png

        for b in batches:
            img = [encode_png(np.add.outer(np.arange(h), np.arange(w) * 3)[..., None].repeat(3, 2).astype(np.uint8)) for w, h in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(img, pa.binary())], [*b.schema.names, "image"])

    rows = meta(spark, d).select("_idx", (16 + F.col("width") % 16).alias("width"), (16 + F.col("height") % 16).alias("height"))
    return dealt(rows).mapInArrow(make, "_idx long, width long, height long, image binary")
