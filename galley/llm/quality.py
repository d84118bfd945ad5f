"""Operator 2. Quality classifier: document evidence combined with host and path posteriors by empirical Bayes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.llm import common, textkit

#: Labelled rows the document classifier is fitted on at most: those of least hash of the id. Their features, 26
#: numbers a row, are all that comes to the driver.
FIT_ROWS = 20_000
N = 26


def features(texts: pa.Array) -> np.ndarray:
    """Shape of each whole text: word lengths, case, signs, digits, repetition, sentence and line lengths; and squares."""
    out = []
    batch = pa.RecordBatch.from_arrays([texts], ["text"])
    for part in textkit.slices(batch):
        data, offsets = textkit.utf8(part.column("text"))
        starts, ends, bounds = textkit.word_spans(data, offsets)

        def per(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(flags)])
            return (sums[at[1:]] - sums[at[:-1]]).astype(float)

        sign = ((data > 32) & (data < 48)) | ((data > 57) & (data < 65)) | ((data > 90) & (data < 97)) | ((data > 122) & (data < 127))
        sign &= ~np.isin(data, [44, 46])
        words, size = np.diff(bounds).astype(float), np.diff(offsets).astype(float)
        w, b = np.maximum(words, 1), np.maximum(size, 1)
        last = data[ends - 1] if len(ends) else data[:0]
        h = textkit.quick_hashes(data, starts, ends)
        same = np.zeros(len(h), bool)
        same[1:] = h[1:] == h[:-1]
        length = ends - starts
        seen = np.array([len(np.unique(h[lo:hi])) for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], float)
        lone = (length == 1) & sign[starts] if len(starts) else same
        x = np.stack([
            np.log1p(words), per(length, bounds) / w / 10, per(sign, offsets) / b * 5, per((data > 64) & (data < 91), offsets) / b * 3,
            per((data > 47) & (data < 58), offsets) / b * 5, per(same, bounds) / w * 3, seen / w, per(lone, bounds) / w * 3,
            per(sign[ends - 1] if len(ends) else same, bounds) / w * 2, per(np.isin(last, [33, 46, 63]), bounds) / w * 3,
            np.log1p(per(data == 10, offsets)) / 4, per(length > 20, bounds) / w * 3, np.log1p(words / np.maximum(seen, 1)),
        ], 1)
        out.append(np.concatenate([x, x * x], 1))
    return np.concatenate(out) if out else np.zeros((0, N))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Logistic regression by Newton steps: weights, means and scales of the features, and the share of good rows.
    Without labels of both kinds the weights are 0."""
    rate = (y.sum() + 1) / (len(y) + 2)
    mean, scale = (x.mean(0), x.std(0) + 1e-9) if len(x) else (np.zeros(N), np.ones(N))
    z = np.concatenate([(x - mean) / scale, np.ones((len(x), 1))], 1)
    weights = np.zeros(N + 1)
    weights[-1] = np.log(rate / (1 - rate))
    if 0 < y.sum() < len(y):
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(z @ weights, -30, 30)))
            penalty = np.full(N + 1, ridge)
            penalty[-1] = 0
            step = np.linalg.solve((z.T * (p * (1 - p))) @ z + np.diag(penalty + 1e-9), z.T @ (y - p) - penalty * weights)
            weights += step
            if np.abs(step).max() < 1e-6:
                break
    return weights, mean, scale, float(rate)


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def document_model(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, rows: int = FIT_ROWS):
    """Fit on at most rows labelled documents, chosen by hash of the id whatever the tables' size; as many ids and labels
    are sent to all tasks, so that no text moves but theirs."""
    shape = F.arrow_udf(lambda t: pa.array(list(features(t)), pa.list_(pa.float64())), "array<double>")
    chosen = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    found = common.materialize(texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", shape("text").alias("x")), "labelled")
    table = found.orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(rows).toArrow()  # rows that share an id count too
    x = np.array(table["x"].to_pylist(), float).reshape(-1, N)
    return fit(x, np.asarray(table["quality"], float))


def _strength(mean: float, between: float) -> float:
    """Prior weight, in documents, of a beta distribution with this mean and variance, kept within 4 and 10,000."""
    return float(min(max(mean * (1 - mean) / max(between, 1e-9) - 1, 4.0), 1e4))


def classify(
    docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5,
    carry: list[str] | None = None,
) -> DataFrame:
    """docs with doc_score, host_posterior, path_posterior, quality and keep (quality >= threshold).

    doc_score is the chance that a document is good by its own shape. Host and path posteriors are the expected
    share of good documents there, without the document itself: a path is shrunk toward its host and a host toward
    all documents, the more the fewer documents it has; how much follows from the spread between hosts and between
    paths, found by grouped sums over all documents. quality adds the path's log odds, less those of all documents,
    to the document's own. Null hosts and paths are the empty one; null and empty texts have a score like any other.
    A result column that docs has already is replaced. Rows that share an id are scored each by its own text, which may be
    of any length; an empty table gives no rows. carry names the columns of docs that the result has, all if None; without the text among them
    the scores are written once and every text is read by the classifier once only.
    """
    weights, mean, scale, rate = document_model(docs, labels, id_col, text_col)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        x = (features(texts) - mean) / scale
        return pa.array(1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30))))

    h, q = F.coalesce(host.cast("string"), F.lit("")), F.coalesce(path.cast("string"), F.lit(""))
    scored = docs.withColumns({"doc_score": score(F.col(f"`{text_col}`")), "__galley_host": h, "__galley_path": q})
    carry = docs.columns if carry is None else carry
    scored = scored.select(*[F.col(f"`{c}`") for c in carry if c != "doc_score"], "doc_score", "__galley_host", "__galley_path")
    if text_col not in carry:
        scored = common.materialize(scored, "scored")
    by_path = scored.groupBy("__galley_host", "__galley_path").agg(
        F.count("*").alias("__galley_n"), F.sum("doc_score").alias("__galley_s"), F.sum(F.col("doc_score") * F.col("doc_score")).alias("__galley_ss")
    )
    by_path = common.materialize(by_path, "paths")
    by_host = by_path.groupBy("__galley_host").agg(
        F.sum("__galley_n").alias("__galley_hn"), F.sum("__galley_s").alias("__galley_hs"), F.sum("__galley_ss").alias("__galley_hss")
    )
    by_host = common.materialize(by_host, "hosts")

    def spread(groups: DataFrame, n: str, s: str, ss: str, centre: Column) -> tuple[float, float]:
        """Mean score, and the variance between groups beyond that of sampling within them."""
        size, total = F.col(n), F.col(s)
        within = F.greatest(F.col(ss) - total * total / size, F.lit(0.0))
        row = groups.agg(
            F.sum(size), F.sum(total), F.sum(size * (total / size - centre) * (total / size - centre)), F.sum(within), F.count("*")
        ).first()
        count, found, between, inside, k = (x or 0 for x in row)
        noise = inside / max(count - k, 1) * k
        return (found / count if count else rate), max(between - noise, 0.0) / max(count, 1)

    overall = by_host.agg(F.sum("__galley_hs") / F.sum("__galley_hn")).first()[0]
    overall = rate if overall is None else float(overall)
    _, between = spread(by_host, "__galley_hn", "__galley_hs", "__galley_hss", F.lit(overall))
    sites = by_path.join(by_host, "__galley_host")
    _, inner = spread(sites, "__galley_n", "__galley_s", "__galley_ss", F.col("__galley_hs") / F.col("__galley_hn"))
    at_host, at_path = _strength(overall, between), _strength(overall, inner)
    sites = common.materialize(sites.drop("__galley_ss", "__galley_hss"), "sites")

    own = F.col("doc_score")
    joined = scored.join(sites, ["__galley_host", "__galley_path"])
    joined = joined.withColumn("host_posterior", (F.col("__galley_hs") - own + at_host * overall) / (F.col("__galley_hn") - 1 + at_host))
    joined = joined.withColumn("path_posterior", (F.col("__galley_s") - own + at_path * F.col("host_posterior")) / (F.col("__galley_n") - 1 + at_path))
    total = _logit(own) + _logit(F.col("path_posterior")) - _logit(F.lit(overall))
    joined = joined.withColumn("quality", 1 / (1 + F.exp(-total))).withColumn("keep", F.col("quality") >= threshold)
    names = [c for c in carry if c not in ("doc_score", "host_posterior", "path_posterior", "quality", "keep")]
    return joined.select(*[F.col(f"`{c}`") for c in names], "doc_score", "host_posterior", "path_posterior", "quality", "keep")


def classify_documents(docs: DataFrame, labels: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """classify() for the documents table: host and path are the parts of source before and after its first slash;
    the language stands in for a path where source has none."""
    source = F.regexp_replace(F.coalesce(F.col("source"), F.lit("")), "^[a-z]+://", "")
    rest = F.regexp_extract(source, "^[^/]*/([^/?#]*)", 1)
    return classify(docs, labels, F.substring_index(source, "/", 1), F.when(rest != "", rest).otherwise(F.col("lang")), carry=carry)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's scores and whether it is kept."""
    found = classify_documents(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"), ["doc_id", "source", "lang"])
    return found.select("doc_id", "source", "lang", "doc_score", "host_posterior", "path_posterior", "quality", "keep")
