"""All queries of the point-cloud side and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rot
from ..functions import vec as v
from ..functions.chance import uniform
from ..operators import cleaning, clouds, evaluate, features, mesh, neighbors, orient, poses, ranks, register, sampling, spheres
from . import views as w

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
CFG = features.MatchConfig()
#: The fixed motion that queries move clouds by.
ANGLES = ("0.3e0", "-0.2e0", "0.5e0")
SHIFT = ("0.01e0", "-0.02e0", "0.03e0")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# Pairs, index and votes

R = CFG.pair_distance
_Q = v.vec("q_"), v.vec("q_n")
_F = [f"{e} AS f{i + 1}" for i, e in enumerate(features.feature_exprs(_Q[0], _Q[1], v.vec(""), v.vec("n")))]
_PAIR = ["obj", "q_pt_id AS i", "pt_id AS j", *_F, f"{features.alpha_expr(_Q[0], _Q[1], v.vec(''))} AS alpha"]
PF = "pf AS (" + w.nest("(SELECT * FROM near WHERE q_pt_id <> pt_id AND d2 > 0) AS n", [_PAIR, ["*", *features.key_exprs(CFG)]]) + ")"
KEYS = ", ".join(features.KEYS)


@query(w.with_("pts", w.near(R), PF, select=f"SELECT obj, {KEYS}, count(*) AS n FROM pf GROUP BY obj, {KEYS}"))
def ppf_index_hist(spark, sf_dir):
    return features.index_histogram(features.pairs(w.points(spark, sf_dir), CFG))


_SHOWN = ["obj", "i", "j", *w.rounded("f1 f2 f3 f4 alpha")]


@query(w.with_("pts", w.near(R), PF, select=f"SELECT {', '.join(_SHOWN)} FROM pf"))
def ppf_features(spark, sf_dir):
    return features.pairs(w.points(spark, sf_dir), CFG).selectExpr(*_SHOWN)


@query(w.with_("pts", w.near(R), PF, select=f"SELECT {KEYS}, count(*) AS n FROM pf GROUP BY {KEYS} ORDER BY n DESC, {KEYS} LIMIT 20"))
def ppf_bucket_topk(spark, sf_dir):
    g = features.pairs(w.points(spark, sf_dir), CFG).groupBy(*features.KEYS).agg(F.count("*").alias("n"))
    return g.orderBy(F.desc("n"), *features.KEYS).limit(20)


_TURN = f"cast(floor(round({{}} + pi(), 9) / (2 * pi() / {CFG.alpha_bins})) AS int)"
_ACC = f"""rf AS (SELECT obj, pt_id AS i FROM (SELECT *, row_number() OVER (PARTITION BY obj ORDER BY pt_id) - 1 AS r FROM pts) AS t WHERE r % {CFG.scene_step} = 0),
acc AS (SELECT scene, model, s_i, m_i, bin, sum(sn * mn) AS votes FROM (
  SELECT s.scene, m.model, s.s_i, m.m_i, ((mb - sb) % {CFG.alpha_bins} + {CFG.alpha_bins}) % {CFG.alpha_bins} AS bin, sn, mn FROM
  (SELECT obj AS scene, {KEYS}, i AS s_i, {_TURN.format("alpha")} AS sb, count(*) AS sn FROM pf JOIN rf USING (obj, i) GROUP BY ALL) s JOIN
  (SELECT obj AS model, {KEYS}, i AS m_i, {_TURN.format("alpha")} AS mb, count(*) AS mn FROM pf GROUP BY ALL) m USING ({KEYS})) AS x
  GROUP BY scene, model, s_i, m_i, bin)"""
_BEST = "best AS (SELECT scene, model, s_i, m_i, bin, votes FROM (SELECT *, row_number() OVER (PARTITION BY scene, model, s_i ORDER BY votes DESC, m_i, bin) AS r FROM acc) AS a WHERE r = 1)"


def _acc(spark, sf_dir, best=False):
    """All points, and the votes (or the best of each block) of each label's cloud, as a scene, for each label's cloud as a model."""
    pts = w.points(spark, sf_dir)
    refs = clouds.sample_uniform(pts, CFG.scene_step)
    return pts, features.votes(features.pairs(pts, CFG, refs), features.train(pts, CFG), CFG, best)


@query(w.with_("pts", w.near(R), PF, _ACC, select="SELECT scene, model, s_i, m_i, bin, cast(votes AS bigint) AS votes FROM acc"))
def hough_accumulator(spark, sf_dir):
    return _acc(spark, sf_dir)[1]


@query(w.with_("pts", w.near(R), PF, _ACC, _BEST, select="SELECT scene, model, s_i, m_i, bin, cast(votes AS bigint) AS votes FROM best"))
def hough_argmax(spark, sf_dir):
    return features.best_votes(_acc(spark, sf_dir, best=True)[1])


_R, _T = features.pose_exprs(v.vec("s_"), v.vec("s_n"), v.vec("m_"), v.vec("m_n"), "alpha")
_COORDS = ("x", "y", "z", "nx", "ny", "nz")
_HYP = [
    ["scene", "model", "s_i", "m_i", "votes", "alpha", "s_x", "s_y", "s_z", "m_x", "m_y", "m_z", *rot.aliased(_R)],
    ["scene", "model", "s_i", "m_i", "votes", "alpha", *rot.NAMES, *[f"{e} AS t{a}" for a, e in zip("xyz", _T, strict=True)]],
]
_HYP_SHOWN = ["scene", "model", "s_i", "m_i", "cast(votes AS bigint) AS votes", *w.rounded(" ".join(rot.NAMES) + " tx ty tz")]
_HYP_BASE = f"""(SELECT b.*, (bin * 2 * pi()) / {CFG.alpha_bins} AS alpha, {', '.join(f's.{c} AS s_{c}' for c in _COORDS)}, {', '.join(f'm.{c} AS m_{c}' for c in _COORDS)}
 FROM best b JOIN pts s ON s.obj = scene AND s.pt_id = s_i JOIN pts m ON m.obj = model AND m.pt_id = m_i) AS h"""


@query(w.with_("pts", w.near(R), PF, _ACC, _BEST, select=w.nest(_HYP_BASE, [*_HYP, _HYP_SHOWN])))
def match_hypotheses(spark, sf_dir):
    pts, acc = _acc(spark, sf_dir, best=True)
    return features.hypotheses(features.best_votes(acc), pts, pts, CFG).selectExpr(*_HYP_SHOWN)


@query()
def match_clusters(spark, sf_dir):
    """The whole chain: hypotheses of each scene and model (scene * 2^32 + model), clustered and thinned."""
    pts, acc = _acc(spark, sf_dir, best=True)
    h = features.hypotheses(features.best_votes(acc), pts, pts, CFG)
    h = h.selectExpr("scene * 4294967296 + model AS scene", "s_i AS pose_id", "cast(votes AS double) AS votes", *rot.NAMES, "tx", "ty", "tz")
    return poses.nms_centre(poses.cluster(h, CFG.position_threshold, CFG.rotation_threshold), 0.05)


# Sampling, bounds and transforms


@query(w.with_("pts", select="SELECT pt_id, obj, round(x, 6) AS x FROM (SELECT *, row_number() OVER (PARTITION BY obj ORDER BY pt_id) - 1 AS r FROM pts) AS t WHERE r % 3 = 0"))
def sample_uniform(spark, sf_dir):
    return clouds.sample_uniform(w.points(spark, sf_dir), 3).selectExpr("pt_id", "obj", "round(x, 6) AS x")


_SUMS = ", ".join(f"sum({v.fixed(c)}) AS {c}" for c in _COORDS)
_MEAN = ["n", *[f"round(cast({c} AS double) / 1e6 / n, 12) AS {c}" for c in "xyz"]]


def _voxel_sql(cells: str, names: str) -> str:
    return f"SELECT obj, {names}, {', '.join(_MEAN)} FROM (SELECT obj, {cells}, count(*) AS n, {_SUMS} FROM pb GROUP BY ALL) AS g"


_PB = "pb AS (SELECT pts.*, b.* EXCLUDE (obj) FROM pts JOIN (SELECT obj, " + ", ".join(f"min({c}) AS {c}min, max({c}) AS {c}max" for c in "xyz") + " FROM pts GROUP BY obj) b USING (obj))"
_REL = ", ".join(f"cast(coalesce(floor(({a} - {a}min) / nullif(0.25 * ({a}max - {a}min), 0)), 0) AS bigint) AS c{a}" for a in "xyz")
_CUBE = ", ".join(f"cast(floor({a} / 0.1) AS bigint) AS c{a}" for a in "xyz")
_BINS = f"cast(floor(round(acos({v.clamp1('nz')}), 9) / 0.8) AS bigint) AS ca, cast(floor(round(atan2(ny, nx) + pi(), 9) / 0.8) AS bigint) AS cb"


def _voxels(df: DataFrame, *names: str) -> DataFrame:
    return df.selectExpr("obj", *names, "n", *w.rounded("x y z", 12))


@query(w.with_("pts", _PB, select=_voxel_sql(_REL, "cx, cy, cz")))
def sample_voxel_avg(spark, sf_dir):
    return _voxels(clouds.sample_voxels(w.points(spark, sf_dir), 0.25), "cx", "cy", "cz")


@query(w.with_("pts", "pb AS (SELECT * FROM pts)", select=_voxel_sql(_CUBE, "cx, cy, cz")))
def sample_voxel_cube(spark, sf_dir):
    return _voxels(clouds.sample_voxels(w.points(spark, sf_dir), 0.1, cubic=True), "cx", "cy", "cz")


@query(w.with_("pts", _PB, select=_voxel_sql(f"{_REL}, {_BINS}", "cx, cy, cz, ca, cb")))
def sample_voxel_normal(spark, sf_dir):
    return _voxels(clouds.sample_voxels(w.points(spark, sf_dir), 0.5, angle=0.8, level=1), "cx", "cy", "cz", "ca", "cb")


_CENTRE = v.norm2(v.sub(v.vec(""), tuple(f"((floor({a} / 2.0) + 0.5) * 2.0)" for a in "xyz")))


@query(
    w.with_("dense", select=f"""SELECT obj, pt_id, x, y, z, n FROM (SELECT *, count(*) OVER p AS n, row_number() OVER (PARTITION BY obj, cx, cy, cz ORDER BY c2, pt_id) AS r
    FROM (SELECT *, floor(x / 2.0) AS cx, floor(y / 2.0) AS cy, floor(z / 2.0) AS cz, round({_CENTRE}, 9) AS c2 FROM dense) AS t WINDOW p AS (PARTITION BY obj, cx, cy, cz)) AS u WHERE r = 1""")
)
def sample_voxel_nearest(spark, sf_dir):
    return clouds.voxel_nearest(w.dense(spark, sf_dir), 2.0)


_BOX = ", ".join(f"min({c}) AS {c}min, max({c}) AS {c}max" for c in "xyz")
_BOX_SHOWN = ["obj", *[f"{c}{m}" for c in "xyz" for m in ("min", "max")], "round(diagonal, 6) AS diagonal"]
_DIAGONAL = "sqrt(" + " + ".join(f"({c}max - {c}min) * ({c}max - {c}min)" for c in "xyz") + ") AS diagonal"


@query(w.with_("dense", select=w.nest(f"(SELECT obj, {_BOX} FROM dense GROUP BY obj) AS b", [["*", _DIAGONAL], _BOX_SHOWN])))
def bbox(spark, sf_dir):
    return clouds.bounds(w.dense(spark, sf_dir)).selectExpr(*_BOX_SHOWN)


_NORM_CO = "co AS (SELECT obj, " + ", ".join(f"cast(sum({v.fixed(c)}) AS double) / count(*) / 1e6 AS c{c}" for c in "xyz") + ", min(least(x, y, z)) AS lo, max(greatest(x, y, z)) AS hi FROM pts GROUP BY obj)"


@query(w.with_("pts", _NORM_CO, select="SELECT pt_id, obj, " + ", ".join(f"round(({c} - c{c}) * 2.0 / nullif(hi - lo, 0), 6) AS {c}" for c in "xyz") + " FROM pts JOIN co USING (obj)"))
def normalize_coeff(spark, sf_dir):
    return clouds.normalize(w.points(spark, sf_dir), 2.0).selectExpr("pt_id", "obj", *w.rounded("x y z"))


_MOTION = rot.euler(ANGLES)
_MOVED = dict(zip("xyz", v.add(rot.apply(_MOTION, v.vec("")), SHIFT), strict=True)) | dict(zip(("nx", "ny", "nz"), rot.apply(_MOTION, v.vec("n")), strict=True))


@query(w.with_("pts", select="SELECT pt_id, obj, " + ", ".join(f"round({e}, 6) AS {c}" for c, e in _MOVED.items()) + " FROM pts"))
def transform_rigid(spark, sf_dir):
    return clouds.transform(w.points(spark, sf_dir), _MOTION, SHIFT).selectExpr("pt_id", "obj", *w.rounded(" ".join(_COORDS)))


@query(w.with_("pts", select=f"SELECT obj, count(*) AS n, sum({v.fixed(v.norm(v.vec('')))}) / 1e6 AS dist, " + ", ".join(f"round(cast(sum({v.fixed(c)}) AS double) / 1e6 / count(*), 9) AS m{c}" for c in "xyz") + " FROM pts GROUP BY obj"))
def dist_to_origin(spark, sf_dir):
    p = w.points(spark, sf_dir)
    means = [F.expr(f"round(cast(sum({v.fixed(c)}) AS double) / 1e6 / count(*), 9)").alias(f"m{c}") for c in "xyz"]
    return p.groupBy("obj").agg(F.count("*").alias("n"), (F.sum(F.expr(v.fixed(v.norm(v.vec(""))))) / 1e6).alias("dist"), *means)


def _scalar(name: str, base: str, exprs: list[str], load) -> None:
    """A query of row expressions that both engines read as they are."""
    names = [e.rpartition(" AS ")[2] for e in exprs]
    key = "pose_id" if base == "poses" else "pt_id"
    shown = [key, *w.rounded(" ".join(names))]
    ORACLE_SQL[name] = w.with_(base, select=w.nest(base, [[key, *exprs], shown]))
    QUERIES[name] = lambda spark, sf_dir: load(spark, sf_dir).selectExpr(key, *exprs).selectExpr(*shown)


_scalar("euler_to_rot", "pts", rot.aliased(rot.euler(("x", "y", "z"))), w.points)
_scalar("axis_angle_to_rot", "pts", rot.aliased(rot.axis_angle(v.vec("n"), "x")), w.points)
_scalar("quat_to_rot", "poses", [f"{n} AS {n}" for n in rot.NAMES], w.poses)
_scalar("rot_to_quat", "poses", [f"abs({e}) AS q{a}" for a, e in zip("wxyz", rot.to_quat(rot.NAMES), strict=True)], w.poses)
_scalar("rot_angle", "poses", [f"{rot.angle(rot.NAMES)} AS angle", *[f"{e} AS a{c}" for c, e in zip("xyz", rot.to_axis(rot.NAMES), strict=True)]], w.poses)
_scalar("frame_to_x", "pts", rot.aliased(rot.to_x(v.vec("n"))), w.points)
_scalar("compose_rigid", "poses", rot.aliased(rot.times(_MOTION, rot.NAMES)) + [f"{e} AS u{a}" for a, e in zip("xyz", v.add(rot.apply(_MOTION, v.vec("t")), SHIFT), strict=True)], w.poses)
_scalar("normal_flip", "pts", [f"{e} AS n{a}" for a, e in zip("xyz", v.flip(v.vec("n"), v.vec(""), ("0e0", "0e0", "0e0")), strict=True)], w.points)
_scalar("shrink_p", "pts", [f"{v.shrink(v.norm(v.vec('')) + ' * 4', '0.5e0', '10e0')} AS factor"], w.points)
_scalar("angles", "pts", [f"{v.angle(v.vec('n'), v.unit(v.vec('')))} AS a", f"{v.angle_atan2(v.vec('n'), v.vec(''))} AS b", f"{v.dist_so2('x * 20', 'y * 20')} AS so2", f"{v.dist_l1(v.vec(''), v.vec('n'))} AS l1"], w.points)


# Neighbours

_NN = ["q_pt_id", "pt_id", "cast(rank AS int) AS rank", "round(d2, 9) AS d2"]


@query(w.with_("pts", w.knn(5), select=f"SELECT {', '.join(_NN)} FROM nn"))
def knn_k5(spark, sf_dir):
    p = w.points(spark, sf_dir)
    return neighbors.knn(p, p, 5, 0.15).selectExpr(*_NN)


_MOVED_PTS = "mv AS (SELECT obj, pt_id, x + 0.02 AS x, y - 0.01 AS y, z + 0.01 AS z, nx, ny, nz FROM pts)"


def _moved(spark, sf_dir):
    return w.points(spark, sf_dir).withColumns({"x": F.col("x") + 0.02, "y": F.col("y") - 0.01, "z": F.col("z") + 0.01})


@query(w.with_("pts", _MOVED_PTS, w.knn(1, "mv", "pts", True), select="SELECT q_pt_id, pt_id, round(d2, 9) AS d2 FROM nn"))
def nn1(spark, sf_dir):
    return neighbors.nearest(_moved(spark, sf_dir), w.points(spark, sf_dir), 0.1).selectExpr("q_pt_id", "pt_id", "round(d2, 9) AS d2")


@query(w.with_("pts", _MOVED_PTS, w.knn(1, "mv", "pts", True), select="SELECT q_pt_id, pt_id FROM (SELECT *, row_number() OVER (PARTITION BY obj, pt_id ORDER BY d2, q_pt_id) AS r FROM nn) AS t WHERE r = 1"))
def picky_bijection(spark, sf_dir):
    return neighbors.bijective(neighbors.nearest(_moved(spark, sf_dir), w.points(spark, sf_dir), 0.1)).select("q_pt_id", "pt_id")


@query(w.with_("pts", w.near(0.12), select="SELECT q_pt_id, pt_id, round(d2, 9) AS d2 FROM near"))
def radius_join(spark, sf_dir):
    p = w.points(spark, sf_dir)
    return neighbors.radius_join(p, p, 0.12).selectExpr("q_pt_id", "pt_id", "round(d2, 9) AS d2")


@query(w.with_("dense", w.near(1.5, "dense", strict=False), select="SELECT q_obj AS obj, q_pt_id AS pt_id, count(*) AS n FROM near GROUP BY ALL"))
def count_in_sphere(spark, sf_dir):
    d = w.dense(spark, sf_dir)
    return spheres.count_in_sphere(d, d, 1.5)


@query(w.with_("dense", select="SELECT pt_id, obj FROM dense WHERE x BETWEEN 10 AND 30 AND y BETWEEN 20 AND 50 AND z BETWEEN 2 AND 6"))
def in_box(spark, sf_dir):
    return neighbors.in_box(w.dense(spark, sf_dir), (10, 20, 2), (30, 50, 6)).select("pt_id", "obj")


@query(w.with_("pts", w.near(0.1, "pts", "(SELECT * FROM pts WHERE pt_id % 7 = 0)", strict=False), select="SELECT pt_id, obj FROM pts WHERE pt_id NOT IN (SELECT q_pt_id FROM near)"))
def remove_in_sphere(spark, sf_dir):
    p = w.points(spark, sf_dir)
    return neighbors.remove_in_sphere(p, p.where("pt_id % 7 = 0"), 0.1).select("pt_id", "obj")


_PAIRS6 = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
_COV = f"""cov AS (SELECT obj, pt_id, n, {', '.join(f"cast(s{a}{b} AS double) / 1e9 - (cast(s{a} AS double) / 1e9) * (cast(s{b} AS double) / 1e9) / n AS c{a}{b}" for a, b in _PAIRS6)} FROM
 (SELECT q_obj AS obj, q_pt_id AS pt_id, count(*) AS n, {', '.join(f"sum({v.fixed(a, 9)}) AS s{a}" for a in 'xyz')}, {', '.join(f"sum({v.fixed(f'{a} * {b}', 9)}) AS s{a}{b}" for a, b in _PAIRS6)}
  FROM nn GROUP BY q_obj, q_pt_id) AS g)"""
_COV_SHOWN = ["obj", "pt_id", *w.rounded(" ".join(f"c{a}{b}" for a, b in _PAIRS6))]


@query(w.with_("pts", w.knn(6, include_self=True), _COV, select=f"SELECT {', '.join(_COV_SHOWN)} FROM cov"))
def covariance(spark, sf_dir):
    return cleaning.covariances(w.points(spark, sf_dir), 6, 0.2).selectExpr(*_COV_SHOWN)


_NORMALS_SHOWN = ["obj", "pt_id", *w.rounded("nx ny nz", 4), "round(curvature, 6) AS curvature"]


@query(w.with_("pts", w.knn(6, include_self=True), _COV, select=w.nest("cov", [*cleaning.normal_steps("obj", "pt_id"), _NORMALS_SHOWN])))
def normals_knn(spark, sf_dir):
    return cleaning.normals(w.points(spark, sf_dir), 6, 0.2).selectExpr(*_NORMALS_SHOWN)


_SIGMA = "sg AS (SELECT obj, q_pt_id AS q, sqrt(cast(sum({}) AS double) / 1e12 / count(*)) AS sigma FROM nn GROUP BY obj, q_pt_id)".format(v.fixed("d2", 12))
_AROUND = "ar AS (SELECT nn.obj, q_pt_id AS q, cast(sum({}) AS double) / 1e9 / count(*) AS around FROM nn JOIN sg ON sg.obj = nn.obj AND sg.q = nn.pt_id GROUP BY nn.obj, q_pt_id)".format(v.fixed("sigma", 9))
_PLOF = "pl AS (SELECT sg.obj, sg.q, sigma, sigma / nullif(around, 0) - 1 AS plof FROM sg JOIN ar ON sg.obj = ar.obj AND sg.q = ar.q)"
_NPLOF = "np AS (SELECT obj, sqrt(cast(sum({}) AS double) / 1e9 / count(*)) AS nplof FROM pl GROUP BY obj)".format(v.fixed("plof * plof", 9))
_LOOP = f"lp AS (SELECT pl.obj, q AS pt_id, sigma, CASE WHEN plof <= 0 THEN 0e0 ELSE {cleaning.outlier_probability()} END AS score FROM pl JOIN np ON pl.obj = np.obj)"
_LOOP_PARTS = ("pts", w.knn(8), _SIGMA, _AROUND, _PLOF, _NPLOF, _LOOP)


@query(w.with_(*_LOOP_PARTS, select="SELECT obj, pt_id, round(sigma, 6) AS sigma, round(score, 6) AS score FROM lp"))
def loop_outlier_score(spark, sf_dir):
    return cleaning.outlier_scores(w.points(spark, sf_dir), 8, 0.2).selectExpr("obj", "pt_id", *w.rounded("sigma score"))


@query(w.with_(*_LOOP_PARTS, select="SELECT obj, pt_id FROM lp WHERE round(score, 6) > 0.6"))
def loop_outlier_select(spark, sf_dir):
    return cleaning.outlier_scores(w.points(spark, sf_dir), 8, 0.2).where("round(score, 6) > 0.6").select("obj", "pt_id")


@query(w.with_("pts", w.knn(6, include_self=True), select=f"SELECT q_obj AS obj, q_pt_id AS pt_id, round(cast(sum({v.fixed('z')}) AS double) / 1e6 / count(*), 12) AS z FROM nn GROUP BY q_obj, q_pt_id"))
def smooth_quality(spark, sf_dir):
    return cleaning.smooth(w.points(spark, sf_dir), "z", 6, 0.2).selectExpr("obj", "pt_id", "round(z, 12) AS z")


# Statistics


@query(w.with_("dense", select="SELECT obj, quantile_disc(y, 0.5) AS median FROM dense GROUP BY obj"))
def lower_median(spark, sf_dir):
    return ranks.lower_median(w.dense(spark, sf_dir), "obj", "y")


_THR = f"""m AS (SELECT obj, quantile_disc(y, 0.5) AS median FROM dense GROUP BY obj),
dv AS (SELECT obj, quantile_disc(abs(y - median), 0.5) AS mad FROM dense JOIN m USING (obj) GROUP BY obj),
th AS (SELECT obj, median, mad, median + 2.5 * {clouds.MAD} * mad AS threshold FROM m JOIN dv USING (obj))"""


@query(w.with_("dense", _THR, select="SELECT obj, median, round(mad, 6) AS mad, round(threshold, 6) AS threshold FROM th"))
def mad_threshold(spark, sf_dir):
    return clouds.rejection_threshold(w.dense(spark, sf_dir), "obj", "y", 2.5).selectExpr("obj", "median", *w.rounded("mad threshold"))


@query(w.with_("dense", _THR, select="SELECT obj, pt_id FROM dense JOIN th USING (obj) WHERE y < threshold / 10"))
def robust_inliers(spark, sf_dir):
    return clouds.robust_inliers(w.dense(spark, sf_dir), "obj", "y", 2.5).select("obj", "pt_id")


@query(w.with_("dense", select="SELECT cast(CASE WHEN y < 10 THEN 0 WHEN y >= 60 THEN 26 ELSE floor((y - 10) * 25 / 50) + 1 END AS bigint) AS bin, count(*) AS n FROM dense GROUP BY ALL"))
def histogram(spark, sf_dir):
    return clouds.histogram(w.dense(spark, sf_dir), F.col("y"), 10.0, 60.0, 25)


@query(w.with_("dense", select="SELECT obj, x, y, z, min(pt_id) AS pt_id FROM dense GROUP BY obj, x, y, z"))
def drop_duplicates(spark, sf_dir):
    return clouds.drop_duplicates(w.dense(spark, sf_dir)).select("obj", "x", "y", "z", "pt_id")


@query(w.with_("pts", "poses", select="SELECT obj, count(*) AS n FROM (SELECT obj FROM pts UNION ALL SELECT scene FROM poses) AS t GROUP BY obj"))
def append_clouds(spark, sf_dir):
    both = clouds.merge(w.points(spark, sf_dir), w.poses(spark, sf_dir).selectExpr("cast(scene AS int) AS obj", "tx AS x", "ty AS y", "tz AS z"))
    return both.groupBy("obj").agg(F.count("*").alias("n"))


# Poses


def _near_model(spark, sf_dir):
    """Small motions of each label's cloud: its points under the label's poses, made slight turns and shifts."""
    p = w.poses(spark, sf_dir)
    small = rot.euler(("tx * 0.5", "ty * 0.5", "tz * 0.5"))
    p = p.selectExpr("pose_id", "cast(scene AS int) AS model", *rot.aliased(small), "tx * 0.1 AS tx", "ty * 0.1 AS ty", "tz * 0.1 AS tz")
    return poses.placed(p, w.points(spark, sf_dir))


_PLACED_POINT = dict(zip("xyz", v.add(rot.apply(rot.named(), v.vec("")), v.vec("u")), strict=True)) | dict(zip(("nx", "ny", "nz"), rot.apply(rot.named(), v.vec("n")), strict=True))
_PLACED = "pp AS (SELECT pose_id, pt_id, {} FROM (SELECT pose_id, scene, {}, tx * 0.1 AS ux, ty * 0.1 AS uy, tz * 0.1 AS uz FROM poses) AS o JOIN pts AS m ON m.obj = o.scene)".format(
    ", ".join(f"{e} AS {c}" for c, e in _PLACED_POINT.items()), ", ".join(rot.aliased(rot.euler(("tx * 0.5", "ty * 0.5", "tz * 0.5"))))
)
_OVERLAP = f"""hit AS (SELECT pose_id, m_id FROM (SELECT q.pose_id, q.pt_id AS m_id, {v.norm2(v.sub(v.of('p'), v.of('q')))} AS d2, {v.dot(v.of('q', 'n'), v.of('p', 'n'))} AS c,
 row_number() OVER (PARTITION BY q.pose_id, q.pt_id ORDER BY {v.norm2(v.sub(v.of('p'), v.of('q')))}, p.pt_id) AS r FROM pp q JOIN pts AS p ON abs(p.x - q.x) < 0.15 AND abs(p.y - q.y) < 0.15 AND abs(p.z - q.z) < 0.15) AS t
 WHERE r = 1 AND d2 < 0.0225 AND c > cos(0.5))"""


@query(w.with_("pts", "poses", _PLACED, _OVERLAP, select="SELECT pose_id, n, coalesce(hits, 0) AS hits, round(coalesce(hits, 0) / n, 6) AS overlap FROM (SELECT pose_id, count(*) AS n FROM pp GROUP BY 1) AS a LEFT JOIN (SELECT pose_id, count(*) AS hits FROM hit GROUP BY 1) AS b USING (pose_id)"))
def overlap_ratio(spark, sf_dir):
    scene = w.points(spark, sf_dir)
    return poses.overlap_ratio(_near_model(spark, sf_dir), scene, 0.15, 0.5).selectExpr("pose_id", "n", "hits", "round(overlap, 6) AS overlap")


_CELL = ", ".join(f"cast(floor({c} / 0.1) AS bigint) AS c{c}" for c in "xyz")
_FREE = f"""full_ AS (SELECT DISTINCT {_CELL} FROM pts),
bx AS (SELECT {', '.join(f'min(c{c}) AS lo{c}, max(c{c}) AS hi{c}' for c in 'xyz')} FROM full_),
free_ AS (SELECT x.c AS cx, y.c AS cy, z.c AS cz FROM bx, {', '.join(f'unnest(range(lo{c}, hi{c} + 1)) AS {c}(c)' for c in 'xyz')} EXCEPT SELECT cx, cy, cz FROM full_)"""


@query(w.with_("pts", "poses", _PLACED, _FREE, select=f"SELECT pose_id, count(*) AS n, count(f.cx) AS in_free, round(count(f.cx) / count(*), 6) AS ratio FROM (SELECT pose_id, {_CELL} FROM pp) AS p LEFT JOIN free_ f USING (cx, cy, cz) GROUP BY pose_id"))
def freespace_count(spark, sf_dir):
    scene = w.points(spark, sf_dir)
    return poses.free_space_hits(_near_model(spark, sf_dir), poses.free_space(scene, 0.1), 0.1).selectExpr("pose_id", "n", "in_free", "round(ratio, 6) AS ratio")


_SDF = f"sdf AS (SELECT cx, cy, cz, cast(min({v.fixed('z')}) AS double) / 1e6 AS sdf FROM (SELECT *, {_CELL} FROM pts) AS t GROUP BY cx, cy, cz)"


@query(w.with_("pts", "poses", _PLACED, _SDF, select=f"SELECT pose_id, count(*) AS n, count(CASE WHEN abs(sdf) < 0.05 THEN 1 END) AS near, round(count(CASE WHEN abs(sdf) < 0.05 THEN 1 END) / count(*), 6) AS ratio FROM (SELECT pose_id, {_CELL} FROM pp) AS p LEFT JOIN sdf USING (cx, cy, cz) GROUP BY pose_id"))
def sdf_ratio(spark, sf_dir):
    grid = neighbors.celled(w.points(spark, sf_dir), 0.1).groupBy("cx", "cy", "cz").agg((F.min(F.expr(v.fixed("z"))) / 1e6).alias("sdf"))
    return poses.sdf_ratio(_near_model(spark, sf_dir), grid, 0.1, 0.05).selectExpr("pose_id", "n", "near", "round(ratio, 6) AS ratio")


@query()
def pose_cluster(spark, sf_dir):
    return poses.cluster(w.poses(spark, sf_dir), 0.2, 0.8, weighted=True)


@query()
def pose_cluster_r3(spark, sf_dir):
    return poses.cluster(w.poses(spark, sf_dir), 0.2, None)


_BEFORE = "SELECT * FROM (SELECT p.scene, p.pose_id AS a, q.pose_id AS b, {} AS hit FROM poses p JOIN poses q ON p.scene = q.scene AND p.pose_id <> q.pose_id{}) AS t WHERE hit"
_FAR = v.norm2(tuple(f"(p.t{c} - q.t{c})" for c in "xyz"))
_HALF = (0.1, 0.2, 0.1)


def _side(i: int, c: str) -> str:
    """The common length of two turned boxes' bounds along an axis."""
    reach = {p: "(" + " + ".join(f"abs({p}.r{i}{j}) * {h}" for j, h in enumerate(_HALF)) + ")" for p in "pq"}
    return f"greatest(0, least(p.t{c} + {reach['p']}, q.t{c} + {reach['q']}) - greatest(p.t{c} - {reach['p']}, q.t{c} - {reach['q']}))"


def _volume(p: str) -> str:
    return " * ".join("(2 * (" + " + ".join(f"abs({p}.r{i}{j}) * {h}" for j, h in enumerate(_HALF)) + "))" for i in range(3))


_COMMON = " * ".join(_side(i, c) for i, c in enumerate("xyz"))
_KEPT = "SELECT scene, pose_id, votes FROM poses JOIN kp USING (scene, pose_id)"


@query(w.with_(w.recursive("poses"), *w.greedy("poses", "scene", "pose_id", "votes DESC, pose_id", "(" + _BEFORE.format(f"{_FAR} < 0.2 * 0.2", "") + ")"), select=_KEPT))
def nms_center(spark, sf_dir):
    return poses.nms_centre(w.poses(spark, sf_dir), 0.2).select("scene", "pose_id", "votes")


@query(w.with_(w.recursive("poses"), *w.greedy("poses", "scene", "pose_id", "votes DESC, pose_id", "(" + _BEFORE.format(f"{_COMMON} > 0.2 * ({_volume('p')} + {_volume('q')} - {_COMMON})", "") + ")"), select=_KEPT))
def nms_bbox(spark, sf_dir):
    return poses.nms_boxes(w.poses(spark, sf_dir), _HALF, 0.2).select("scene", "pose_id", "votes")


_Q4 = ("qw", "qx", "qy", "qz")
_AT = lambda i, j: f"a{min(i, j)}{max(i, j)}"
_UPPER = [(i, j) for i in range(4) for j in range(i, 4)]
_SQUARED = {ij: "(" + " + ".join(f"{_AT(ij[0], k)} * {_AT(k, ij[1])}" for k in range(4)) + ")" for ij in _UPPER}
_TRACE = " + ".join(_SQUARED[i, i] for i in range(4))
# Squared again and again and scaled to a trace of 1, the matrix becomes the projector onto its leading eigenvector.
_POWER = [
    "mm AS (SELECT scene, count(*) AS n, " + ", ".join(f"cast(sum(cast(floor({_Q4[i]} * {_Q4[j]} * votes * 1e9 + 0.5) AS bigint)) AS double) / 1e9 AS {_AT(i, j)}" for i, j in _UPPER) + " FROM poses GROUP BY scene)",
    "sq AS (SELECT *, 0 AS step FROM mm UNION ALL SELECT scene, n, " + ", ".join(f"{e} / ({_TRACE})" for e in _SQUARED.values()) + ", step + 1 FROM sq WHERE step < 40)",
    "top AS (SELECT *, list_position([a00, a11, a22, a33], greatest(a00, a11, a22, a33)) AS j FROM sq WHERE step = 40)",
]


@query(w.with_(w.recursive("poses"), *_POWER, select="SELECT scene, n, " + ", ".join(f"round([{', '.join(_AT(i, j) for j in range(4))}][j] / sqrt([a00, a11, a22, a33][j]), 6) AS {q}" for i, q in enumerate(_Q4)) + " FROM top"))
def markley_avg(spark, sf_dir):
    return poses.mean_rotation(w.poses(spark, sf_dir), weight="votes").selectExpr("scene", "n", *w.rounded(" ".join(_Q4)))


@query()
def spectral_score(spark, sf_dir):
    near = neighbors.nearest(_moved(spark, sf_dir), w.points(spark, sf_dir), 0.1)
    c = near.selectExpr("cast(obj AS bigint) AS pose_id", *[f"q_{a} AS p{a}" for a in "xyz"], *[f"{a} AS q{a}" for a in "xyz"])
    return poses.spectral_scores(c, 0.05)


# Registration

_PLANE_SHOWN = ["obj", "pairs", *w.rounded(" ".join([f"a{i}{j}" for i in range(6) for j in range(i, 6)] + [f"b{i}" for i in range(6)]))]
_A, _B = register.plane_rows(v.vec("p"), v.vec("q"), v.vec("n"))
_PAIRED = "pr AS (SELECT obj, " + ", ".join([f"q_{c} AS p{c}" for c in "xyz"] + [f"{c} AS q{c}" for c in "xyz"]) + ", nx, ny, nz FROM nn)"
_PLANE = "SELECT obj, count(*) AS pairs, " + ", ".join([f"cast(sum({v.fixed(f'({_A[i]}) * ({_A[j]})', 9)}) AS double) / 1e9 AS a{i}{j}" for i in range(6) for j in range(i, 6)] + [f"cast(sum({v.fixed(f'({_A[i]}) * {_B}', 9)}) AS double) / 1e9 AS b{i}" for i in range(6)]) + " FROM pr GROUP BY obj"


def _paired(spark, sf_dir):
    near = neighbors.nearest(_moved(spark, sf_dir), w.points(spark, sf_dir), 0.1)
    return near.selectExpr("obj", *[f"q_{c} AS p{c}" for c in "xyz"], *[f"{c} AS q{c}" for c in "xyz"], "nx", "ny", "nz")


@query(w.with_("pts", _MOVED_PTS, w.knn(1, "mv", "pts", True), _PAIRED, select=w.nest(f"({_PLANE}) AS s", [_PLANE_SHOWN])))
def p2plane_normal_eq(spark, sf_dir):
    return register.plane_sums(_paired(spark, sf_dir), "obj").selectExpr(*_PLANE_SHOWN)


_CROSS_SHOWN = ["obj", "pairs", *w.rounded(" ".join(f"w{i}{j}" for i in range(3) for j in range(3)))]
_CROSS = "SELECT obj, count(*) AS pairs, " + ", ".join([f"cast(sum({v.fixed(f'{s}{c}', 9)}) AS double) / 1e9 AS s{s}{c}" for s in "pq" for c in "xyz"] + [f"cast(sum({v.fixed(f'p{a} * q{b}', 9)}) AS double) / 1e9 AS s{a}{b}" for a in "xyz" for b in "xyz"]) + " FROM pr GROUP BY obj"
_CENTRED = ["obj", "pairs", *[f"s{a}{b} - sp{a} * sq{b} / pairs AS w{i}{j}" for i, a in enumerate("xyz") for j, b in enumerate("xyz")]]


@query(w.with_("pts", _MOVED_PTS, w.knn(1, "mv", "pts", True), _PAIRED, select=w.nest(f"({_CROSS}) AS s", [_CENTRED, _CROSS_SHOWN])))
def cross_covariance(spark, sf_dir):
    return register.cross_covariance(_paired(spark, sf_dir), "obj").selectExpr(*_CROSS_SHOWN)


def _motion_rows(spark, name: str, m) -> DataFrame:
    return spark.createDataFrame([(name, *[round(float(x), 6) for x in m[:3].ravel()])], "name string, " + ", ".join(f"m{i}{j} double" for i in range(3) for j in range(4)))


@query()
def icp_refine(spark, sf_dir):
    """The motion that takes a slightly moved copy of all points back."""
    dst = w.points(spark, sf_dir)
    src = clouds.transform(dst, rot.euler(("0.01e0", "-0.01e0", "0.01e0")), ("0.003e0", "0.002e0", "-0.002e0"))
    pose, _ = register.icp(src, dst, register.IcpConfig(), radius=0.05)
    return _motion_rows(spark, "icp", pose)


@query()
def refine_poses(spark, sf_dir):
    """All poses of the table, made small, as starts from which label 0's cloud finds back into the scene of all points; then suppression."""
    pts = w.points(spark, sf_dir)
    starts = w.poses(spark, sf_dir).selectExpr("pose_id", "scene", "votes", "20 + abs(qw) AS a", "qx", "qy", "qz", *[f"t{c} / 50 AS t{c}" for c in "xyz"])
    starts = starts.selectExpr("*", "sqrt(a * a + qx * qx + qy * qy + qz * qz) AS n").selectExpr("pose_id", "scene", "votes", "a / n AS qw", *[f"q{c} / n AS q{c}" for c in "xyz"], "tx", "ty", "tz")
    starts = starts.selectExpr("scene", "pose_id", "votes", *rot.aliased(rot.quat(("qw", "qx", "qy", "qz"))), "tx", "ty", "tz")
    out = register.post_process(starts, pts.where("obj = 0"), pts, 0.002, register.IcpConfig(6, 0.05, 25.0, 1), 0.2)
    return out.selectExpr("scene", "pose_id", *w.rounded("tx ty tz error", 5))


@query()
def normals_oriented(spark, sf_dir):
    """Normals of all clouds, turned to agree along each neighbour graph's minimum spanning forest."""
    pts = w.points(spark, sf_dir)
    found = cleaning.normals(pts, 8, 0.5).select("obj", "pt_id", "nx", "ny", "nz")
    turned = orient.orient_normals(pts.drop("nx", "ny", "nz").join(found, ["obj", "pt_id"]), 8, 0.5)
    return turned.selectExpr("obj", "pt_id", *w.rounded("nx ny nz", 5))


@query()
def sparse_icp(spark, sf_dir):
    dst = w.points(spark, sf_dir)
    src = clouds.transform(dst, rot.euler(("0.01e0", "-0.01e0", "0.01e0")), ("0.003e0", "0.002e0", "-0.002e0"))
    return _motion_rows(spark, "sparse", register.sparse_icp(src, dst, 0.05))


# Greedy thinning, planes and parts


_THIN = [w.recursive("pts"), w.near(0.1), *w.greedy("pts", "obj", "pt_id", "pt_id", "(SELECT obj, q_pt_id AS a, pt_id AS b FROM near)")]


@query(w.with_(*_THIN, select="SELECT obj, pt_id FROM kp"))
def poisson_disk(spark, sf_dir):
    return cleaning.poisson_disk(w.points(spark, sf_dir), 0.1).select("obj", "pt_id")


@query(w.with_(*_THIN, select="SELECT n.obj, n.q_pt_id AS pt_id, arg_min(n.pt_id, (n.d2, n.pt_id)) AS target FROM near n JOIN kp ON kp.obj = n.obj AND kp.pt_id = n.pt_id GROUP BY 1, 2"))
def merge_close(spark, sf_dir):
    return cleaning.merge_close(w.points(spark, sf_dir), 0.1)


@query(
    w.with_("RECURSIVE pts AS " + w.CTE["pts"].removeprefix("pts AS "), w.near(0.1), "reach AS (SELECT obj, pt_id AS a, pt_id AS b FROM pts UNION SELECT r.obj, r.a, n.pt_id FROM reach r JOIN near n ON n.obj = r.obj AND n.q_pt_id = r.b)", select="SELECT obj, a AS pt_id, min(b) AS part FROM reach GROUP BY obj, a")
)
def connected_components(spark, sf_dir):
    return cleaning.connected_parts(w.points(spark, sf_dir), 0.1)


@query()
def plane_subtract(spark, sf_dir):
    return cleaning.subtract_plane(w.points(spark, sf_dir), 0.02).select("obj", "pt_id")


# Evaluation

_ADD = f"SELECT obj, count(*) AS n, round(cast(sum({v.fixed(v.norm(v.sub(v.of('a'), v.of('b'))), 9)}) AS double) / 1e9 / count(*), 6) AS error FROM pts a JOIN tr b USING (obj, pt_id) GROUP BY obj"
_TR = "tr AS (SELECT obj, pt_id, " + ", ".join(f"{e} AS {c}" for c, e in _MOVED.items()) + " FROM pts)"


@query(w.with_("pts", _TR, select=_ADD))
def add_metric(spark, sf_dir):
    p = w.points(spark, sf_dir)
    return evaluate.add_error(p, clouds.transform(p, _MOTION, SHIFT)).selectExpr("obj", "n", "round(error, 6) AS error")


@query(w.with_("pts", _TR, w.knn(1, "tr", "pts", True), select=f"SELECT q_obj AS obj, count(*) AS n, round(cast(sum({v.fixed('sqrt(d2)', 9)}) AS double) / 1e9 / count(*), 6) AS error FROM nn GROUP BY q_obj"))
def adi_metric(spark, sf_dir):
    p = w.points(spark, sf_dir)
    return evaluate.adi_error(p, clouds.transform(p, _MOTION, SHIFT), 0.2).selectExpr("obj", "n", "round(error, 6) AS error")


def _hits(spark, sf_dir):
    return w.results(spark, sf_dir).withColumn("hit", F.col("value") > 50)


_RATE = "SELECT object, count(CASE WHEN value > 50 THEN 1 END) AS num, count(*) AS den FROM results"


@query(w.with_("results", select=f"SELECT count(*) AS objects, round(avg(num / den), 9) AS rate FROM ({_RATE} GROUP BY object) AS t"))
def recall_macro(spark, sf_dir):
    return evaluate.recall_macro(_hits(spark, sf_dir)).selectExpr("objects", "round(rate, 9) AS rate")


@query(w.with_("results", select=f"SELECT object, num, den, round(num / den, 9) AS rate FROM ({_RATE} GROUP BY ROLLUP (object)) AS t"))
def recall_rollup(spark, sf_dir):
    return evaluate.recall_rollup(_hits(spark, sf_dir)).selectExpr("object", "num", "den", "round(rate, 9) AS rate")


@query(w.with_("results", select=f"SELECT object, num, den, round(num / den, 9) AS rate FROM ({_RATE} WHERE user_id % 100 < 84 GROUP BY object) AS t"))
def recall_occlusion(spark, sf_dir):
    return evaluate.recall_by_object(_hits(spark, sf_dir).where("user_id % 100 < 84")).selectExpr("object", "num", "den", "round(rate, 9) AS rate")


_SIDES = "lk AS (SELECT DISTINCT key FROM results WHERE value > 95), rk AS (SELECT DISTINCT key FROM results WHERE value < 5)"


@query(w.with_("results", _SIDES, select="SELECT key FROM lk INTERSECT SELECT key FROM rk"))
def success_intersect(spark, sf_dir):
    r = w.results(spark, sf_dir)
    return r.where("value > 95").select("key").intersect(r.where("value < 5").select("key"))


@query(w.with_("results", _SIDES, select="SELECT key FROM lk EXCEPT SELECT key FROM rk"))
def success_except(spark, sf_dir):
    r = w.results(spark, sf_dir)
    return r.where("value > 95").select("key").subtract(r.where("value < 5").select("key"))


@query(w.with_("results", _SIDES, select="SELECT side, count(*) AS n FROM (SELECT CASE WHEN lk.key IS NOT NULL AND rk.key IS NOT NULL THEN 'both' WHEN lk.key IS NOT NULL THEN 'left' ELSE 'right' END AS side FROM lk FULL JOIN rk USING (key)) AS t GROUP BY side"))
def success_compare(spark, sf_dir):
    r = w.results(spark, sf_dir)
    return evaluate.compare_keys(r.where("value > 95"), r.where("value < 5"))


# Triangles

_FACES = "fc AS (SELECT * FROM (SELECT obj, pt_id AS face, pt_id AS a, lead(pt_id, 1) OVER (PARTITION BY obj ORDER BY pt_id) AS b, lead(pt_id, 2) OVER (PARTITION BY obj ORDER BY pt_id) AS c FROM pts) AS t WHERE c IS NOT NULL)"
_CORNERED = "cf AS (SELECT fc.*, " + ", ".join(f"p{k}.{x} AS {k}_{x}" for k in "abc" for x in "xyz") + " FROM fc " + " ".join(f"JOIN pts p{k} ON p{k}.obj = fc.obj AND p{k}.pt_id = fc.{k}" for k in "abc") + ")"
_WIDE = mesh.normal_exprs()
_EDGES = "ed AS (SELECT obj, p, q, count(*) AS faces FROM (" + " UNION ALL ".join(f"SELECT obj, least({x}, {y}) AS p, greatest({x}, {y}) AS q FROM fc" for x, y in ("ab", "bc", "ca")) + ") AS t GROUP BY obj, p, q)"


def _faces(spark, sf_dir):
    p = w.points(spark, sf_dir)
    return mesh.strip(p), p


@query(w.with_("pts", _FACES, _CORNERED, select=f"SELECT obj, count(*) AS n, cast(sum({v.fixed(v.norm(_WIDE) + ' / 2', 9)}) AS double) / 1e9 AS area FROM cf GROUP BY obj"))
def mesh_area(spark, sf_dir):
    return mesh.areas(*_faces(spark, sf_dir))


_AREAS = f"""ar AS (SELECT *, cast(sum(area) OVER (PARTITION BY obj ORDER BY face) AS bigint) AS hi FROM
    (SELECT *, {v.fixed(v.norm(_WIDE) + ' / 2', 9)} AS area FROM cf) AS t WHERE area > 0)"""
_PLACES = f"""pl AS (SELECT obj, sample, cast(floor({uniform(11, 'obj', 'sample', duck=True)} * total) AS bigint) AS place
    FROM (SELECT obj, max(hi) AS total, unnest(range(500)) AS sample FROM ar GROUP BY obj) AS t)"""
_ON_FACE = ", ".join(f"round({e}, 6) AS {x}" for e, x in zip(sampling.barycentric(11, duck=True), "xyz", strict=True))


@query(w.with_("pts", _FACES, _CORNERED, _AREAS, _PLACES, select=f"SELECT obj, sample, face, {_ON_FACE} FROM pl JOIN ar USING (obj) WHERE hi - area <= place AND place < hi"))
def sample_surface(spark, sf_dir):
    return sampling.surface(*_faces(spark, sf_dir), 500, 11).selectExpr("obj", "sample", "face", *w.rounded("x y z"))


_HEAVY = "sqrt(x * x + y * y + z * z)"
_DRAW = f"-ln({uniform(7, 'coalesce(obj, -1)', 'pt_id', duck=True)}) / {_HEAVY}"


@query(w.with_("dense", select=f"SELECT obj, pt_id, round(draw, 9) AS draw FROM (SELECT *, row_number() OVER (PARTITION BY obj ORDER BY draw, pt_id) AS k FROM (SELECT *, {_DRAW} AS draw FROM dense WHERE {_HEAVY} > 0) AS t) AS t WHERE k <= 300"))
def sample_weighted(spark, sf_dir):
    return sampling.weighted(w.dense(spark, sf_dir), 300, _HEAVY, 7).selectExpr("obj", "pt_id", "round(draw, 9) AS draw")


_VN = "vn AS (SELECT obj, pt_id, count(*) AS faces, " + ", ".join(f"cast(sum({v.fixed(f'w{x}', 9)}) AS double) AS w{x}" for x in "xyz") + " FROM (SELECT obj, unnest([a, b, c]) AS pt_id, " + ", ".join(f"{e} AS w{x}" for e, x in zip(_WIDE, "xyz", strict=True)) + " FROM cf) AS t GROUP BY obj, pt_id)"
_VN_SHOWN = ["obj", "pt_id", "faces", *[f"round({e}, 6) AS n{x}" for e, x in zip(v.unit(v.scale(v.vec("w"), "1e-9")), "xyz", strict=True)]]


@query(w.with_("pts", _FACES, _CORNERED, _VN, select=f"SELECT {', '.join(_VN_SHOWN)} FROM vn"))
def mesh_vertex_normals(spark, sf_dir):
    return mesh.vertex_normals(*_faces(spark, sf_dir)).selectExpr("obj", "pt_id", "faces", *w.rounded("nx ny nz"))


@query(w.with_("pts", _FACES, _EDGES, select="SELECT obj, p, q, faces FROM ed"))
def mesh_edges(spark, sf_dir):
    return mesh.edges(_faces(spark, sf_dir)[0])


@query(
    w.with_("pts", _FACES, _EDGES, select="""SELECT obj, points, edges, faces, borders, points - edges + faces AS euler FROM
    (SELECT obj, count(DISTINCT p) AS points FROM (SELECT obj, unnest([a, b, c]) AS p FROM fc) AS t GROUP BY obj) AS x JOIN
    (SELECT obj, count(*) AS edges, count(CASE WHEN faces = 1 THEN 1 END) AS borders FROM ed GROUP BY obj) AS y USING (obj) JOIN
    (SELECT obj, count(*) AS faces FROM fc GROUP BY obj) AS z USING (obj)""")
)
def mesh_euler(spark, sf_dir):
    return mesh.euler_numbers(_faces(spark, sf_dir)[0])


@query(w.with_("dense", select="SELECT obj, arg_min(a, (face, a, b, c)) AS a, arg_min(b, (face, a, b, c)) AS b, arg_min(c, (face, a, b, c)) AS c, min(face) AS face FROM (SELECT obj, pt_id AS face, x, y, z, cast(x AS bigint) AS a, cast(floor(y) AS bigint) AS b, cast(z AS bigint) AS c FROM (SELECT obj, pt_id, x, y, floor(z) AS z FROM dense) AS d) AS f WHERE a <> b AND b <> c AND a <> c GROUP BY obj, list_sort([a, b, c])"))
def mesh_duplicate_faces(spark, sf_dir):
    f = w.dense(spark, sf_dir).selectExpr("obj", "pt_id AS face", "cast(x AS bigint) AS a", "cast(floor(y) AS bigint) AS b", "cast(floor(z) AS bigint) AS c")
    return mesh.drop_duplicate_faces(f).select("obj", "a", "b", "c", "face")


@query(w.with_("pts", _FACES, select="SELECT obj, pt_id FROM pts WHERE (obj, pt_id) NOT IN (SELECT obj, a FROM fc)"))
def mesh_unreferenced(spark, sf_dir):
    f, p = _faces(spark, sf_dir)
    return mesh.unreferenced(p, f.selectExpr("obj", "a", "a AS b", "a AS c")).select("obj", "pt_id")


# Further statistics and comparisons


@query(w.with_("dense", select="SELECT obj, y AS percentile FROM (SELECT obj, y, row_number() OVER (PARTITION BY obj ORDER BY y) - 1 AS i, count(*) OVER (PARTITION BY obj) AS n FROM dense) AS t WHERE i = greatest(0, trunc(n * 0.9::DOUBLE)::BIGINT - 1)"))
def percentile(spark, sf_dir):
    return ranks.percentile(w.dense(spark, sf_dir), "obj", "y", 0.9)


@query(w.with_("dense", """h AS (SELECT obj, cast(CASE WHEN y < 0 THEN 0 WHEN y >= 110 THEN 56 ELSE floor(y * 55 / 110) + 1 END AS bigint) AS bin, count(*) AS n FROM dense GROUP BY ALL),
c AS (SELECT obj, bin, sum(n) OVER (PARTITION BY obj ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY obj) AS total FROM h)""",
    select="SELECT obj, CASE WHEN min(bin) > 55 THEN 'Infinity'::DOUBLE ELSE round(min(bin) * 2e0, 6) END AS percentile FROM c WHERE upto >= 0.9::DOUBLE * total GROUP BY obj"))
def histogram_percentile(spark, sf_dir):
    """The upper edge of the bin that reaches nine tenths of each cloud's values."""
    counts = clouds.histogram(w.dense(spark, sf_dir), F.col("y"), 0.0, 110.0, 55, "obj")
    return ranks.histogram_percentile(counts, 0.9, 0.0, 110.0, 55, "obj").selectExpr("obj", "round(percentile, 6) AS percentile")


_CENTRE = ", ".join(f"round(cast(sum(cast(floor(((x * x + 1) * {a}) * 1e9 + 0.5) AS bigint)) AS double) / sum(cast(floor((x * x + 1) * 1e9 + 0.5) AS bigint)), 6) AS c{a}" for a in "xyz")


@query(w.with_("pts", select=f"SELECT obj, {_CENTRE} FROM pts GROUP BY obj"))
def weighted_centre(spark, sf_dir):
    return clouds.weighted_centre(w.points(spark, sf_dir), "x * x + 1").selectExpr("obj", *w.rounded("cx cy cz"))


@query(
    w.with_("pts", """co AS (SELECT sum(cast(floor(x * 1e6 + 0.5) AS bigint)) / count(*) / 1e6 AS cx, sum(cast(floor(y * 1e6 + 0.5) AS bigint)) / count(*) / 1e6 AS cy,
    sum(cast(floor(z * 1e6 + 0.5) AS bigint)) / count(*) / 1e6 AS cz, min(least(x, y, z)) AS lo, max(greatest(x, y, z)) AS hi FROM pts WHERE obj = 0)""",
    select="SELECT pt_id, obj, round((x - cx) * 2.0 / (hi - lo), 6) AS x, round((y - cy) * 2.0 / (hi - lo), 6) AS y, round((z - cz) * 2.0 / (hi - lo), 6) AS z FROM pts, co")
)
def apply_coeff(spark, sf_dir):
    """All clouds by the coefficients of label 0's cloud."""
    pts = w.points(spark, sf_dir)
    co = clouds.normalize(pts, 2.0).where("obj = 0").select("cx", "cy", "cz", "lo", "hi").distinct()
    labels = pts.select("obj").distinct()
    return clouds.apply_coefficients(pts, labels.join(F.broadcast(co)), 2.0).selectExpr("pt_id", "obj", *w.rounded("x y z"))


@query(w.with_("pts", "bx AS (SELECT obj, " + ", ".join(f"min({c}) AS {c}min, max({c}) AS {c}max" for c in "xyz") + " FROM pts GROUP BY obj)", select="SELECT l.obj AS l_obj, r.obj AS r_obj FROM bx l JOIN bx r ON " + " AND ".join(f"l.{c}min <= r.{c}max AND r.{c}min <= l.{c}max" for c in "xyz")))
def boxes_meet(spark, sf_dir):
    b = clouds.bounds(w.points(spark, sf_dir))
    return clouds.boxes_meet(b, b)


@query(w.with_("results", _SIDES, select="SELECT key FROM lk UNION SELECT key FROM rk"))
def success_union(spark, sf_dir):
    r = w.results(spark, sf_dir)
    return evaluate.compare_union(r.where("value > 95"), r.where("value < 5"))


@query(
    w.with_("RECURSIVE pts AS " + w.CTE["pts"].removeprefix("pts AS "), w.near(0.08), "reach AS (SELECT obj, pt_id AS a, pt_id AS b FROM pts UNION SELECT r.obj, r.a, n.pt_id FROM reach r JOIN near n ON n.obj = r.obj AND n.q_pt_id = r.b)",
    select="SELECT obj, a AS pt_id FROM reach GROUP BY obj, a HAVING count(*) >= 3")
)
def drop_small_parts(spark, sf_dir):
    return cleaning.drop_small_parts(w.points(spark, sf_dir), 0.08, 3).select("obj", "pt_id")


@query(w.with_("pts", w.near(0.1, refs="(SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY obj ORDER BY pt_id) - 1 AS r FROM pts) AS t WHERE r % 10 = 0)", strict=False, where="q.nx * p.nx + q.ny * p.ny + q.nz * p.nz > cos(1.2)"), select="SELECT obj, pt_id FROM pts WHERE (obj, pt_id) NOT IN (SELECT q_obj, q_pt_id FROM near)"))
def remove_in_sphere_normal(spark, sf_dir):
    """The centres are a uniform sample of a tenth of the points."""
    pts = w.points(spark, sf_dir)
    return neighbors.remove_in_sphere_normal(pts, clouds.sample_uniform(pts, 10), 0.1, 1.2).select("obj", "pt_id")


@query(w.with_("poses", select="SELECT scene, pose_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY votes DESC, pose_id) AS rank FROM poses) AS t WHERE rank <= 5"))
def strongest_poses(spark, sf_dir):
    return poses.strongest(w.poses(spark, sf_dir), 5).select("scene", "pose_id", "rank")


@query(w.with_("poses", select="SELECT pose_id, round(pow(qw - 1, 2) + pow(qx, 2) + pow(qy, 2) + pow(qz, 2), 6) AS dist, round(2 * acos(least(1, abs(qw))), 6) AS angle FROM poses"))
def dist_so3(spark, sf_dir):
    """Each pose's quaternion against that of no turn, and the turn."""
    pair = ("qw", "qx", "qy", "qz"), ("1e0", "0e0", "0e0", "0e0")
    return w.poses(spark, sf_dir).selectExpr("pose_id", f"round({v.dist_so3(*pair)}, 6) AS dist", f"round({v.angle_so3(*pair)}, 6) AS angle")
