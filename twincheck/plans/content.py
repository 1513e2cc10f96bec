"""Queries over texts, vectors, frames and waveforms."""

from __future__ import annotations

import math

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import media, pitch, text
from .tabular import rounded

SCALE = 400.0
#: Positions that these queries and their SQL take; the operators themselves, and the queries named "_all", take all.
FRAMES, TEXTS, SOUNDS, IMAGES = 64, 200, 50, 200


def corpora(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text IS NOT NULL")
    return text.positioned(df.where("doc_id % 2 = 0"), "doc_id", "text"), text.positioned(df.where("doc_id % 2 = 1"), "doc_id", "text")


def vectors(spark: SparkSession, sf_dir: str, scale: float | None = None) -> tuple[DataFrame, DataFrame]:
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("v", F.transform("embedding", lambda x: x.cast("double") * F.lit(scale or 1.0)))
    return text.positioned(df.where("vec_id % 2 = 0"), "vec_id", "v"), text.positioned(df.where("vec_id % 2 = 1"), "vec_id", "v")


def bleu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(text.bleu(*corpora(spark, sf_dir)))


def rouge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(text.rouge(*corpora(spark, sf_dir)))


def rouge_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(text.rouge_l(*corpora(spark, sf_dir)))


def perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(text.perplexity(*corpora(spark, sf_dir)))


def paired_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(text.paired_cosine(*vectors(spark, sf_dir)))


def coherence(spark: SparkSession, sf_dir: str, most: int | None = TEXTS) -> DataFrame:
    real, synth = (text.coherence(v, most=most) for v in vectors(spark, sf_dir))
    both = real.select(F.col("coherence").alias("real")).join(synth.select(F.col("coherence").alias("synth")))
    return rounded(both.withColumn("score", F.least(F.coalesce(F.try_divide("synth", "real"), F.lit(1.0)), F.lit(1.0))))


def frechet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.frechet(*vectors(spark, sf_dir), "v", 64)


def frame_error(spark: SparkSession, sf_dir: str, most: int | None = FRAMES) -> DataFrame:
    return rounded(media.frame_error(*vectors(spark, sf_dir, SCALE), most=most))


def flow_consistency(spark: SparkSession, sf_dir: str, most: int | None = FRAMES) -> DataFrame:
    return rounded(media.flow_consistency(*vectors(spark, sf_dir, SCALE), most=most))


def temporal_coherence(spark: SparkSession, sf_dir: str, most: int | None = FRAMES) -> DataFrame:
    return rounded(media.temporal_coherence(*vectors(spark, sf_dir, SCALE), most=most))


def scene_cuts(spark: SparkSession, sf_dir: str, most: int | None = FRAMES) -> DataFrame:
    return rounded(media.scene_cuts(*vectors(spark, sf_dir, SCALE), threshold=50.0, most=most))


def waveform_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector is a short waveform of 64 samples."""
    return rounded(media.waveform_correlation(*vectors(spark, sf_dir), least=32))


def snr_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(media.snr_similarity(*vectors(spark, sf_dir), least=32), 5)


def inception_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Softmax of each vector stands in for a classifier's probabilities."""
    odds = vectors(spark, sf_dir)[1].withColumn("e", F.transform("v", lambda x: F.exp(x)))
    return rounded(media.inception_score(odds.select("pos", F.transform("e", lambda x: x / F.aggregate("e", F.lit(0.0), lambda s, y: s + y)).alias("v"))))


def prosody(spark: SparkSession, sf_dir: str, most: int | None = SOUNDS) -> DataFrame:
    """At 400 samples a second, 64 samples are 14 frames of 10."""
    return rounded(media.prosody(*vectors(spark, sf_dir), rate=400, most=most))


def structural_similarity(spark: SparkSession, sf_dir: str, most: int | None = IMAGES) -> DataFrame:
    """Each vector is an image of 8 by 8."""
    return rounded(media.structural_similarity(*vectors(spark, sf_dir, SCALE), shape=(8, 8, 1), most=most))


def pitch_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tone of half a second for each vector, as high as its first component says."""
    tone = lambda first: F.transform(F.sequence(F.lit(0), F.lit(3199)), lambda t: F.sin(t * (2 * math.pi / 6400) * (300 + 200 * first)))
    real, synth = (d.select("pos", F.col("v")[0].alias("v")) for d in vectors(spark, sf_dir))
    return rounded(pitch.pitch_matching(real, synth, rate=6400, wave=tone))


QUERIES = {f.__name__: f for f in (inception_score, pitch_matching, prosody, structural_similarity, bleu, rouge, rouge_l, perplexity, paired_cosine, coherence, frechet, frame_error, flow_consistency, temporal_coherence, scene_cuts, waveform_correlation, snr_similarity)}
#: The queries that take the first positions only; with "_all" after its name, each takes them all.
FIRST = {"coherence": " WHERE pos <= 200", "frame_error": " WHERE pos <= 64", "flow_consistency": " WHERE a.pos <= 64", "temporal_coherence": " WHERE a.pos <= 64", "scene_cuts": " WHERE a.pos <= 64", "prosody": " WHERE pos <= 50", "structural_similarity": " WHERE pos <= 200"}
QUERIES |= {f"{name}_all": partial(QUERIES[name], most=None) for name in FIRST}

_TEXTS = r"""corpus AS (SELECT doc_id % 2 AS side, row_number() OVER (PARTITION BY doc_id % 2 ORDER BY doc_id) AS pos, list_filter(string_split_regex(lower(text), '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL)"""


def _grams(n: int) -> str:
    gram = "array_to_string(w[i:i + {k}], ' ')".format(k=n - 1)
    return f"g{n} AS (SELECT side, pos, gram, count(*) AS c FROM (SELECT side, pos, {gram} AS gram FROM (SELECT side, pos, w, unnest(range(1, len(w) - {n - 2})) AS i FROM corpus WHERE len(w) >= {n})) GROUP BY ALL)"


_BLEU_PARTS = " UNION ALL ".join(f"SELECT {n} AS n, sum(least(s.c, coalesce(r.c, 0)))::BIGINT AS matched, sum(s.c)::BIGINT AS total FROM (SELECT * FROM g{n} WHERE side = 1 AND pos IN (SELECT pos FROM corpus WHERE side = 0)) s LEFT JOIN (SELECT * FROM g{n} WHERE side = 0) r USING (pos, gram)" for n in range(1, 5))
_ROUGE = " UNION ALL ".join(
    f"""SELECT {n} AS n, round(avg(p), 6) AS precision, round(avg(q), 6) AS recall, round(avg(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END), 6) AS f1 FROM (
        SELECT coalesce(hit / nullif(greatest(len(s.w) - {n - 1}, 0), 0), 0) AS p, coalesce(hit / nullif(greatest(len(r.w) - {n - 1}, 0), 0), 0) AS q FROM (SELECT * FROM corpus WHERE side = 0) r JOIN (SELECT * FROM corpus WHERE side = 1) s USING (pos)
        LEFT JOIN (SELECT a.pos, sum(least(a.c, b.c)) AS hit FROM g{n} a JOIN g{n} b ON a.pos = b.pos AND a.gram = b.gram AND a.side = 0 AND b.side = 1 GROUP BY a.pos) h USING (pos))"""
    for n in (1, 2)
)
_VEC = "vec AS (SELECT vec_id % 2 AS side, row_number() OVER (PARTITION BY vec_id % 2 ORDER BY vec_id) AS pos, list_transform(embedding::DOUBLE[], lambda x: x * {scale}) AS v FROM embeddings), r AS (SELECT pos, v FROM vec WHERE side = 0), s AS (SELECT pos, v FROM vec WHERE side = 1)"
_COS = "list_inner_product({a}, {b}) / ((sqrt(list_inner_product({a}, {a})) + 1e-8) * (sqrt(list_inner_product({b}, {b})) + 1e-8))"
_FRAMES = _VEC.format(scale=SCALE) + f""", st AS (SELECT a.side, a.pos, list_avg(list_transform(range(1, len(a.v) + 1), lambda i: abs(a.v[i] - b.v[i]))) AS change, {_COS.format(a="a.v", b="b.v")} AS cos FROM vec a JOIN vec b ON a.side = b.side AND b.pos = a.pos - 1 WHERE a.pos <= 64)"""
_UNIT = _VEC.format(scale="1.0") + ", u AS (SELECT side, pos, list_transform(v, lambda x: x / (sqrt(list_inner_product(v, v)) + 1e-8)) AS u FROM vec WHERE pos <= 200), c AS (SELECT n.side, avg(greatest(0, (list_inner_product(n.u, a.u) + list_inner_product(n.u, b.u) + list_inner_product(n.u, d.u)) / 3)) AS c FROM u n JOIN u a ON a.side = n.side AND a.pos = n.pos - 1 JOIN u b ON b.side = n.side AND b.pos = n.pos - 2 JOIN u d ON d.side = n.side AND d.pos = n.pos - 3 GROUP BY n.side)"

ORACLES = {
    "bleu": f"""WITH {_TEXTS}, {", ".join(map(_grams, range(1, 5)))}, parts AS ({_BLEU_PARTS}),
        len AS (SELECT sum(len(r.w)) AS r, sum(len(s.w)) AS s FROM (SELECT * FROM corpus WHERE side = 0) r JOIN (SELECT * FROM corpus WHERE side = 1) s USING (pos))
        SELECT n, matched, total, round(CASE WHEN min(matched) OVER w = 0 THEN 0 ELSE (CASE WHEN s > r THEN 1 ELSE exp(1 - r / s) END) * exp(avg(CASE WHEN matched > 0 THEN ln(matched / total) END) OVER w) END, 6) AS bleu FROM parts, len WINDOW w AS (ORDER BY n)""",
    "rouge": f"WITH {_TEXTS}, {_grams(1)}, {_grams(2)} {_ROUGE}",
    "perplexity": f"""WITH {_TEXTS}, t AS (SELECT w, count(*) FILTER (side = 0) AS r, count(*) FILTER (side = 1) AS s FROM (SELECT side, unnest(w) AS w FROM corpus) GROUP BY w),
        n AS (SELECT sum(r) AS N, count_if(r > 0) AS V, sum(s) AS M FROM t), c AS (SELECT r, s, -log2(CASE WHEN r > 0 THEN (r + 1) / (N + V) ELSE 1e-8 END) AS cost FROM t, n),
        h AS (SELECT sum(r * cost) / any_value(N) AS a, sum(s * cost) / any_value(M) AS b FROM c, n) SELECT round(a, 6) AS h_real, round(b, 6) AS h_synth, round(1 - least(abs(b / a - 1), 1), 6) AS score FROM h""",
    "paired_cosine": f"WITH {_VEC.format(scale='1.0')}, c AS (SELECT {_COS.format(a='r.v', b='s.v')} AS c FROM r JOIN s USING (pos)) SELECT round(avg(c), 6) AS mean, round(stddev_pop(c), 6) AS std, round(min(c), 6) AS min, round(max(c), 6) AS max, count(*) AS pairs FROM c",
    "coherence": f'WITH {_UNIT} SELECT round(a.c, 6) AS "real", round(b.c, 6) AS synth, round(least(b.c / a.c, 1), 6) AS score FROM c a, c b WHERE a.side = 0 AND b.side = 1',
    "frame_error": f"WITH {_VEC.format(scale=SCALE)} SELECT round(avg(list_avg(list_transform(range(1, len(r.v) + 1), lambda i: power((r.v[i] - s.v[i]) / 255, 2)))), 6) AS mse FROM r JOIN s USING (pos) WHERE pos <= 64",
    "flow_consistency": f"WITH {_FRAMES} SELECT round(1 - avg(least(1, abs(b.change / (a.change + 1e-8) - 1))), 6) AS score FROM st a JOIN st b ON a.pos = b.pos AND a.side = 0 AND b.side = 1",
    "temporal_coherence": f"WITH {_FRAMES}, c AS (SELECT avg(greatest(cos, 0)) FILTER (side = 0) AS a, avg(greatest(cos, 0)) FILTER (side = 1) AS b FROM st) SELECT round(a, 6) AS coherence_real, round(b, 6) AS coherence_synth, round(1 - abs(a - b), 6) AS score FROM c",
    "scene_cuts": f"""WITH {_FRAMES}, k AS (SELECT side, pos FROM st WHERE change > 50), n AS (SELECT count_if(side = 0)::BIGINT AS n_real, count_if(side = 1)::BIGINT AS n_synth, (SELECT count(*) FROM k a WHERE side = 0 AND EXISTS (SELECT 1 FROM k b WHERE b.side = 1 AND abs(a.pos - b.pos) <= 1)) AS matched FROM k)
        SELECT n_real, n_synth, matched, round(CASE WHEN n_real + n_synth = 0 THEN 1 ELSE 2 * (matched / greatest(n_synth, 1)) * (matched / greatest(n_real, 1)) / (matched / greatest(n_synth, 1) + matched / greatest(n_real, 1) + 1e-8) END, 6) AS score FROM n""",
    "waveform_correlation": f"WITH {_VEC.format(scale='1.0')} SELECT count(*) AS pairs, round(avg({_COS.format(a='r.v', b='s.v')}), 6) AS correlation FROM r JOIN s USING (pos)",
    "snr_similarity": f"""WITH {_VEC.format(scale="1.0")}, q AS (SELECT side, pos, sqrt(list_avg(list_transform(v, lambda x: x * x))) AS rms, sqrt(list_avg(list_transform(list_sort(list_transform(v, lambda x: abs(x)))[1:6], lambda x: x * x))) AS fl FROM vec), d AS (SELECT side, pos, CASE WHEN fl < 1e-8 THEN 60 ELSE 20 * log10(rms / fl + 1e-8) END AS db FROM q)
        SELECT round(avg(abs(a.db - b.db)), 5) AS mean_difference, round(greatest(0, 1 - avg(abs(a.db - b.db)) / 30), 5) AS score FROM d a JOIN d b ON a.pos = b.pos AND a.side = 0 AND b.side = 1""",
    "inception_score": f"""WITH {_VEC.format(scale="1.0")}, e AS (SELECT pos, list_transform(v, lambda x: exp(x)) AS e FROM s), n AS (SELECT count(*) // 10 AS size FROM s),
        p AS (SELECT (pos - 1) // size AS split, k, e[k] / list_sum(e) AS p FROM e, n, range(1, 65) t(k) WHERE pos <= size * 10),
        m AS (SELECT split, k, avg(p) AS m FROM p GROUP BY ALL), d AS (SELECT split, exp(sum(p * (ln(p + 1e-8) - ln(m + 1e-8))) / any_value(size)) AS s FROM p JOIN m USING (split, k), n GROUP BY split)
        SELECT round(avg(s), 6) AS mean, round(stddev_pop(s), 6) AS std, count(*) AS n_splits FROM d""",
    "prosody": f"""WITH {_VEC.format(scale="1.0")}, b AS (SELECT pos, r.v AS r, s.v AS s FROM r JOIN s USING (pos) WHERE pos <= 50),
        f AS (SELECT pos, sqrt(list_avg(list_transform(r[i:i + 9], lambda x: x * x))) AS x, sqrt(list_avg(list_transform(s[i:i + 9], lambda x: x * x))) AS y FROM b, range(1, 56, 4) t(i)),
        c AS (SELECT pos, corr(x, y) AS c FROM f GROUP BY pos), z AS (SELECT pos, avg(abs(sign(r[k + 1]) - sign(r[k]))) / 2 AS a, avg(abs(sign(s[k + 1]) - sign(s[k]))) / 2 AS b FROM b, range(1, 64) t(k) GROUP BY pos),
        g AS (SELECT avg(greatest(c, 0)) AS e, avg(least(a, b) / (greatest(a, b) + 1e-8)) AS q FROM c JOIN z USING (pos))
        SELECT round(e, 6) AS energy_correlation, round(q, 6) AS rate_similarity, round(0.6 * e + 0.4 * q, 6) AS score FROM g""",
    "structural_similarity": f"""WITH {_VEC.format(scale=SCALE)}, px AS (SELECT pos, k - 1 AS k, r.v[k] AS x, s.v[k] AS y FROM r JOIN s USING (pos), range(1, 65) t(k) WHERE pos <= 200),
        w AS (SELECT pos, i, j, avg(x) AS mx, avg(y) AS my, var_samp(x) AS vx, var_samp(y) AS vy, covar_samp(x, y) AS c FROM px, range(2) a(i), range(2) b(j) WHERE k // 8 BETWEEN i AND i + 6 AND k % 8 BETWEEN j AND j + 6 GROUP BY ALL),
        q AS (SELECT pos, avg((2 * mx * my + 6.5025) * (2 * c + 58.5225) / ((mx * mx + my * my + 6.5025) * (vx + vy + 58.5225))) AS s FROM w GROUP BY pos) SELECT round(avg(s), 6) AS mean, round(stddev_pop(s), 6) AS std, count(*) AS pairs FROM q""",
}
ORACLES |= {f"{name}_all": ORACLES[name].replace(bound, "") for name, bound in FIRST.items()}
