"""A quality classifier with hierarchical empirical Bayes.

A logistic regression on a document's surface gives its evidence. Hosts and paths get posteriors of being good:
the summed probabilities of all their documents, shrunk towards the level above by a concentration that is
fitted to how much sites really differ (method of moments), so sparse sites stay near the global prior. A
document's score is its evidence with the global prior exchanged for its path's posterior, which leaves the
document itself out.
"""

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Labelled rows that the regression is fitted on, at most: those of least hash. All else covers all rows.
MAX_LABELLED = 20_000
THRESHOLD = 0.5
N_FEATURES = 12

_UPPER, _DIGIT = bytes(range(65, 91)), bytes(range(48, 58))
_SYMBOL, _PUNCT, _SPACE = b"%&$*#@^~_=+<>\\{}[]", b"!?|;:()\"'`-/", b" \t\n\r\x0b\x0c"


def features(text: str | None) -> list[float]:
    """Surface measures of a whole text, all finite; an empty text has its own mark."""
    b = (text or "").encode("utf-8", "replace")
    n = len(b)
    if not n:
        return [0.0] * (N_FEATURES - 1) + [1.0]
    share = lambda chars: (n - len(b.translate(None, chars))) / n
    words = b.split()
    many = max(1, len(words))
    distinct = len(set(words)) / many
    lines = b.split(b"\n")
    low = [share(_UPPER), share(_DIGIT), share(_SYMBOL), share(_PUNCT), share(b"|"), share(b"!")]
    return low + [distinct, min(1.0, distinct * math.sqrt(many) / 10), min(3.0, (n - share(_SPACE) * n) / many / 10), math.log1p(many) / 10, len(set(lines)) / len(lines), 0.0]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _features(texts: pd.Series) -> pd.Series:
    return texts.map(features)


def _expanded(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.sqrt(x), np.ones((len(x), 1))])


def _columns(f: Column) -> list[Column]:
    xs = [F.get(f, F.lit(i)) for i in range(N_FEATURES)]
    return xs + [F.sqrt(x) for x in xs] + [F.lit(1.0)]


def fit(x: np.ndarray, y: np.ndarray, steps: int = 40, ridge: float = 1e-3) -> np.ndarray:
    """Weights on _expanded(x) by Newton steps; without labels, or with one class alone, a constant."""
    z = _expanded(x)
    if len(y) == 0 or y.min() == y.max():
        w = np.zeros(z.shape[1])
        w[-1] = 0.0 if len(y) == 0 else 4.0 * (2 * y[0] - 1)
        return w
    mean, dev = z.mean(0), z.std(0)
    keep = dev > 1e-9
    s = np.hstack([(z[:, keep] - mean[keep]) / dev[keep], np.ones((len(z), 1))])
    w = np.zeros(s.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(s @ w, -30, 30)))
        g = s.T @ (p - y) / len(y) + ridge * np.r_[w[:-1], 0]
        h = (s.T * (p * (1 - p) + 1e-9)) @ s / len(y) + ridge * np.eye(len(w))
        w -= np.linalg.solve(h, g)
    out = np.zeros(z.shape[1])
    out[keep] = w[:-1] / dev[keep]
    out[-1] = w[-1] - (w[:-1] / dev[keep]) @ mean[keep]
    return out


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def _site(docs: DataFrame) -> list[Column]:
    """Host and path columns: of a source like host/path the two parts; of a plain source itself and the language."""
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    host = F.substring_index(source, "/", 1)
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    return [host.alias("_q_host"), F.when(F.instr(source, "/") > 0, F.substring_index(F.substr(source, F.length(host) + 2), "/", 1)).otherwise(lang).alias("_q_path")]


def _concentration(level: DataFrame, mean: str) -> float:
    """Beta concentration of sites around `mean` (a column), from all sites with two documents or more."""
    rate = F.col("s") / F.col("n")
    spread = F.sum(F.col("n") * (rate - F.col(mean)) ** 2)
    noise = F.sum(F.col(mean) * (1 - F.col(mean)))
    row = level.where("n >= 2").agg(spread.alias("spread"), noise.alias("noise"), F.sum("n").alias("n"), F.count("*").alias("k")).first()
    if not row.n or row.spread <= row.noise * 1.0001:
        return 1e6
    between = (row.spread - row.noise) / row.n
    return float(min(1e6, max(1.0, row.noise / row.k / between)))


class Model:
    """Fitted weights and site posteriors; score() adds them to rows."""

    def __init__(self, docs: DataFrame, labels: DataFrame):
        site = _site(docs)
        rows = common.materialise(docs.select("doc_id", *site, _features(F.col("text").cast("string")).alias("_q_f")), "features")
        picked = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").alias("_q_id"), F.col("quality").cast("double").alias("_q_y")).orderBy(F.xxhash64("_q_id"), "_q_y").limit(MAX_LABELLED)
        seen = rows.join(F.broadcast(picked), F.col("doc_id") == F.col("_q_id")).orderBy("doc_id").limit(MAX_LABELLED).select("_q_f", "_q_y").toPandas()
        x = np.array(seen["_q_f"].tolist(), float).reshape(-1, N_FEATURES)
        self.weights = fit(x, seen["_q_y"].to_numpy(float))
        p = rows.select("_q_host", "_q_path", self._probability(self._evidence(F.col("_q_f"))).alias("p"))
        paths = common.materialise(p.groupBy("_q_host", "_q_path").agg(F.sum("p").alias("s"), F.count("*").alias("n")), "paths")
        total = paths.agg(F.sum("s"), F.sum("n")).first()
        self.prior = float(total[0] / total[1]) if total[1] else 0.5
        hosts = paths.groupBy("_q_host").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).withColumn("prior", F.lit(self.prior))
        self.host_k = _concentration(hosts, "prior")
        hosts = hosts.select("_q_host", F.col("s").alias("host_s"), F.col("n").alias("host_n"))
        both = paths.join(hosts, "_q_host")
        upper = (F.col("host_s") + self.host_k * self.prior) / (F.col("host_n") + self.host_k)
        self.path_k = _concentration(both.withColumn("upper", upper), "upper")
        self.sites = common.materialise(both.select("_q_host", "_q_path", F.col("s").alias("_q_s"), F.col("n").alias("_q_n"), F.col("host_s").alias("_q_hs"), F.col("host_n").alias("_q_hn")), "sites")
        common.release(paths)
        self.rows = rows

    def _evidence(self, f: Column) -> Column:
        return sum((F.lit(float(w)) * c for w, c in zip(self.weights, _columns(f))), F.lit(0.0))

    @staticmethod
    def _probability(e: Column) -> Column:
        return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), e))))

    def score(self, rows: DataFrame) -> DataFrame:
        """rows (with _q_f, _q_host, _q_path) with _q_evidence, _q_host_posterior, _q_path_posterior, _q_score."""
        p = self._probability(F.col("_q_evidence"))
        host = (F.col("_q_hs") - p + self.host_k * self.prior) / (F.col("_q_hn") - 1 + self.host_k)
        path = (F.col("_q_s") - p + self.path_k * F.col("_q_host_posterior")) / (F.col("_q_n") - 1 + self.path_k)
        prior = math.log(max(1e-6, self.prior) / max(1e-6, 1 - self.prior))
        out = rows.join(self.sites, ["_q_host", "_q_path"]).withColumn("_q_evidence", self._evidence(F.col("_q_f"))).withColumn("_q_host_posterior", host).withColumn("_q_path_posterior", path)
        return out.withColumn("_q_score", self._probability(F.col("_q_evidence") + _logit(F.col("_q_path_posterior")) - F.lit(prior)))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, host, path, evidence, host_posterior, path_posterior, score, keep) of every row.

    Null texts count as empty, null sources and languages as ''. Without labels, or with labels of one class,
    the evidence is a constant. Repeated rows are kept and each counts; other columns are ignored; an empty
    table gives no rows. keep is score >= THRESHOLD.
    """
    model = Model(docs, labels)
    s = model.score(model.rows)
    return s.select("doc_id", F.col("_q_host").alias("host"), F.col("_q_path").alias("path"), F.col("_q_evidence").alias("evidence"), F.col("_q_host_posterior").alias("host_posterior"), F.col("_q_path_posterior").alias("path_posterior"), F.col("_q_score").alias("score"), (F.col("_q_score") >= THRESHOLD).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that classify() keeps, with docs' columns; repeated rows are judged alike. Only site posteriors are joined to the texts."""
    model = Model(docs, labels)
    common.release(model.rows)
    rows = docs.select(*docs.columns, *_site(docs), _features(F.col("text").cast("string")).alias("_q_f"))
    return model.score(rows).where(F.col("_q_score") >= THRESHOLD).select(*docs.columns)
