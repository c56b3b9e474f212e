"""Operator 4: document quality by hierarchical empirical Bayes over hosts and paths."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapegrid.llm.common import cut_lineage, join_counted, map_arrow, sliced
from tapegrid.llm.text_hashes import mix, word_hashes

#: Labelled rows that the document classifier is fitted on at most (about).
MAX_TRAINING = 20_000
FEATURES = (
    "bias", "log_words", "distinct_words", "repeated_next", "commonest_word", "upper", "symbols", "punctuation", "digits", "spaces",
    "mean_word", "long_words", "lines", "repeated_lines", "ends", "pipes",
)
#: Classes of bytes: the columns of a table with a row per byte.
_CLASSES = np.zeros((256, 6), np.float32)
_CLASSES[65:91, 0] = 1
_CLASSES[[ord(c) for c in "#$%&*+<=>@\\^_`~{}[]"], 1] = 1
_CLASSES[[ord(c) for c in "!\"'(),-./:;?"], 2] = 1
_CLASSES[48:58, 3] = 1
_CLASSES[[9, 10, 11, 12, 13, 32], 4] = 1
_CLASSES[124, 5] = 1


#: Texts whose words are held at a time.
PART = 256
#: Buckets that words and pairs of words are hashed to, a power of two, and rows that each counts as having in either class besides its own.
BUCKETS, SMOOTHING = 1 << 15, 2.0


def features(texts: list[bytes]) -> np.ndarray:
    """A row of FEATURES for each text; an empty text has the bias alone."""
    if len(texts) > PART:
        return np.concatenate([features(texts[at : at + PART]) for at in range(0, len(texts), PART)])
    h, _, size, first = word_hashes(texts)
    out = np.zeros((len(texts), len(FEATURES)))
    out[:, 0] = 1
    for k, text in enumerate(texts):
        a, b = int(first[k]), int(first[k + 1])
        if a == b:
            continue
        own, n = h[a:b], b - a
        _, times = np.unique(own, return_counts=True)
        counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        upper, symbols, points, digits, spaces, pipes = counts @ _CLASSES / len(text)
        lines = [x for x in text.split(b"\n") if x.strip()]
        out[k, 1:] = (
            np.log1p(n), len(times) / n, float((own[1:] == own[:-1]).mean()) if n > 1 else 0.0, times.max() / n, upper, symbols, points, digits, spaces,
            min(float(size[a:b].mean()), 30.0) / 10, float((size[a:b] > 20).mean()), len(lines) / n, 1 - len(set(lines)) / len(lines),
            float(np.mean([x.rstrip()[-1:] in b".!?" for x in lines])), pipes,
        )
    # Square roots part the small shares, which most of these are.
    rooted = [FEATURES.index(c) for c in FEATURES[3:10]] + [FEATURES.index(c) for c in FEATURES[11:14]] + [15]
    return np.concatenate((out, np.sqrt(np.maximum(out[:, rooted], 0))), 1)


def word_buckets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The different buckets of each text's words and neighbouring pairs, one text after the other: (text, bucket)."""
    h, _, _, first = word_hashes(texts)
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    pair = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])[text[1:] == text[:-1]]
    key = (np.concatenate((text, text[1:][text[1:] == text[:-1]])).astype(np.int64) * BUCKETS) + (np.concatenate((mix(h), pair)) & np.uint64(BUCKETS - 1)).astype(np.int64)
    key = np.unique(key)
    return key // BUCKETS, key % BUCKETS


def word_scores(texts: list[bytes], odds: np.ndarray) -> np.ndarray:
    """For each text the sum of its buckets' log odds over the root of their number; 0 without words."""
    out = []
    for at in range(0, len(texts), PART):
        part = texts[at : at + PART]
        text, bucket = word_buckets(part)
        out.append(np.bincount(text, odds[bucket], len(part)) / np.sqrt(np.maximum(np.bincount(text, minlength=len(part)), 1)))
    return np.concatenate([np.zeros(0), *out])


def bucket_odds(good: np.ndarray, bad: np.ndarray, n_good: int, n_bad: int) -> np.ndarray:
    """Log odds of a bucket in good against other texts, from the texts of either class that have it; rare buckets are near 0."""
    return np.log((good + SMOOTHING) / (n_good + 2 * SMOOTHING)) - np.log((bad + SMOOTHING * max(n_bad, 1) / max(n_good, 1)) / (n_bad + 2 * SMOOTHING * max(n_bad, 1) / max(n_good, 1)))


@dataclass
class Evidence:
    """Logistic regression on features and, where there are odds of words, on their score; its log odds less the learning rows' are the evidence."""

    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    prior: float
    odds: np.ndarray | None = None

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        x = features(texts) if self.odds is None else np.c_[features(texts), word_scores(texts, self.odds)]
        return np.clip((x - self.mean) / self.scale @ self.weights, -30, 30) - self.prior


def fit(x: np.ndarray, good: np.ndarray, penalty: float = 1.0, steps: int = 25) -> Evidence:
    """By Newton's method with a ridge; without rows of both classes the evidence is nought."""
    y = np.asarray(good, float)
    if len(set(y)) < 2:
        n = x.shape[1]
        return Evidence(np.zeros(n), np.zeros(n), np.ones(n), 0.0)
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1
    mean[0], scale[0] = 0, 1
    x = (x - mean) / scale
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), penalty)
    ridge[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step * min(1, 4 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return Evidence(w, mean, scale, float(np.log(y.mean() / (1 - y.mean()))))


def fit_documents(docs: DataFrame, labels: DataFrame, max_training: int = MAX_TRAINING, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Evidence:
    """The document classifier, from the labelled rows with a text; of more than max_training, those with the smallest hashes of the id."""
    good = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("label_id")).agg(F.max(label_col).alias("good"))
    total = good.count()
    if total > max_training:
        good = good.where(F.pmod(F.xxhash64("label_id"), F.lit(1 << 30)) < int(max_training / total * (1 << 30)))
    # At most about max_training rows of two numbers.
    joined = docs.select(F.col(id_col).alias("label_id"), F.col(text_col).alias("text")).where("text IS NOT NULL").join(F.broadcast(good), "label_id")
    joined = joined.select(F.col("label_id").cast("long").alias("id"), "text", F.col("good").cast("int"), F.pmod(F.xxhash64("label_id", F.lit(9)), F.lit(2)).cast("int").alias("fold"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 2, BUCKETS + 1), np.int64)  # the last place counts texts
        for batch in sliced(batches):
            text, bucket = word_buckets([t.encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()])
            good, fold = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            np.add.at(total, (fold[text], (good[text] > 0).astype(int), bucket), 1)
            np.add.at(total, (fold, (good > 0).astype(int), BUCKETS), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["place", "n"])

    # At most four counts a bucket.
    found = map_arrow(joined, counted, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(4 * (BUCKETS + 1))
    total[found["place"].to_numpy(np.int64)] = found["n"].to_numpy(float)
    total = total.reshape(2, 2, BUCKETS + 1)
    odds = lambda c: bucket_odds(c[1, :-1], c[0, :-1], c[1, -1], c[0, -1])
    # A learning row is scored with the odds of the other half, so that its own words don't speak for it.
    other, whole = (odds(total[1]), odds(total[0])), odds(total.sum(0))
    width = features([b""]).shape[1] + 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = [t.encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            fold = batch.column(3).to_numpy()
            x = np.c_[features(texts), np.where(fold == 0, word_scores(texts, other[0]), word_scores(texts, other[1]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64())), batch.column(2)], ["id", "x", "good"])

    rows = map_arrow(joined, work, "id long, x array<double>, good int").toPandas().sort_values("id", kind="stable")
    made = fit(np.stack(rows["x"].to_numpy()) if len(rows) else np.zeros((0, width)), rows["good"].to_numpy(float))
    return replace(made, odds=whole)


def _log_odds(p: F.Column) -> F.Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def site_quality(docs: DataFrame, evidence: Evidence, host: F.Column, path: F.Column, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, host, path, evidence, prior, score, keep.

    evidence: the document's log Bayes factor for being good. Each host's share of
    good documents is drawn towards the share of all, and each path's towards its
    host's, by as many pseudo-documents as the spread between hosts, or between
    paths within hosts, calls for; sparse ones so take the share above them. The
    document itself is left out of its sites' sums. score: the posterior of that
    prior and the evidence; keep: score >= threshold.

    A null text counts as empty; null hosts and paths are sites of their own name
    ''; null ids stay null; repeated rows are scored each; other columns are left
    out; an empty table gives an empty one.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = evidence([(t or "").encode("utf-8", "surrogatepass") for t in batch.column(3).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(found, pa.float64())], ["id", "host", "path", "evidence"])

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(path.cast("string"), F.lit("")).alias("path"), F.col(text_col).alias("text"))
    rows = cut_lineage(map_arrow(own, work, "id long, host string, path string, evidence double"))
    good = 1 / (1 + F.exp(-(F.col("evidence") + F.lit(evidence.prior))))
    paths = rows.groupBy("host", "path").agg(F.count("*").alias("path_n"), F.sum(good).alias("path_good"))
    hosts = paths.groupBy("host").agg(F.sum("path_n").alias("host_n"), F.sum("path_good").alias("host_good"))
    sites = cut_lineage(paths.join(hosts, "host"))
    every = hosts.agg(F.sum("host_n").alias("n"), F.sum("host_good").alias("good")).first()
    share = every["good"] / every["n"] if every["n"] else 0.5
    noise = max(share * (1 - share), 1e-6)

    def pseudo(table: DataFrame, n: str, part: F.Column, centre: F.Column, units: str) -> float:
        """share * (1 - share) over the variance between sites beyond chance, kept within 1 and 1e6."""
        r = table.agg(F.sum(F.col(n) * (part - centre) ** 2).alias("square"), F.sum(n).alias("n"), F.count("*").alias("sites"), F.expr(units).alias("units")).first()
        spread = ((r["square"] or 0) - noise * max(r["sites"] - 1, 0)) / max((r["n"] or 0) - (r["units"] or 0), 1e-9)
        return float(min(max(noise / spread if spread > 0 else 1e6, 1.0), 1e6))

    host_k = pseudo(hosts, "host_n", F.col("host_good") / F.col("host_n"), F.lit(share), "sum(host_n * host_n) / sum(host_n)")
    path_k = pseudo(sites, "path_n", F.col("path_good") / F.col("path_n"), F.col("host_good") / F.col("host_n"), "sum(path_n * path_n) / sum(path_n)")

    host_share = (F.col("host_good") - good + host_k * share) / (F.col("host_n") - 1 + host_k)
    prior = (F.col("path_good") - good + path_k * host_share) / (F.col("path_n") - 1 + path_k)
    score = 1 / (1 + F.exp(-(F.col("evidence") + F.col("prior"))))
    # A large site's rows stay where they are.
    scored = join_counted(rows, sites, ["host", "path"], "path_n").withColumn("prior", _log_odds(prior)).withColumn("score", score)
    return scored.select(F.col("id").alias(id_col), "host", "path", "evidence", "prior", "score", (F.col("score") >= threshold).alias("keep"))
