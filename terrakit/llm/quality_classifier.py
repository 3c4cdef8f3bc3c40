"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are taken from whole texts inside the tasks. Trees are fitted on a bounded
sample of labelled rows (``TRAIN_ROWS``), on binned values, and flattened into arrays; a
batch of documents goes down all trees at once by array indexing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrakit.llm.common import raw_texts

#: Most labelled rows that the trees are fitted on, those with the smallest id hashes.
TRAIN_ROWS = 20_000

FEATURES = (
    "log_words", "word_length", "symbols", "bangs", "pipes", "upper", "digits", "letters", "beyond_ascii",
    "distinct_words", "distinct_pairs", "next_same", "dup_lines", "line_words", "ended", "longest_word",
)

SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)


def statistics(text: bytes) -> list[float]:
    """The FEATURES of one text; without words all shares are 0."""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    n = max(1, len(words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    n_lines = max(1, len(lines))
    beyond = int(counts[0xC0:].sum())
    upper, lower = int(counts[65:91].sum()), int(counts[97:123].sum())
    chars = max(1, len(text) - int(counts[0x80:0xC0].sum()))
    blanks = int(counts[[9, 10, 11, 12, 13, 32]].sum())
    return [
        float(np.log1p(len(words))),
        (chars - blanks) / n if words else 0.0,
        int(counts[SYMBOLS].sum()) / n,
        int(counts[33]) / n,
        int(counts[124]) / n,
        upper / max(1, upper + lower),
        int(counts[48:58].sum()) / chars,
        (upper + lower + beyond) / chars,
        beyond / chars,
        len(set(words)) / n,
        len(set(zip(words, words[1:]))) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        (len(lines) - len(set(lines))) / n_lines,
        len(words) / n_lines,
        sum(x.rstrip()[-1:] in b".!?" for x in lines) / n_lines,
        float(max(map(len, words), default=0)),
    ]


def fit_trees(
    x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.2, bins: int = 64,
    least: float = 5.0, ridge: float = 1.0,
) -> dict[str, np.ndarray]:
    """Boosted trees for 0/1 labels, each a complete tree of ``depth`` levels in one array.

    Node k has children 2k + 1 and 2k + 2. A node that no split improves keeps an
    infinite threshold, so its rows go left. Without both labels no tree is grown and
    the score is the smoothed share of label 1.
    """
    inner, total = 2**depth - 1, 2 ** (depth + 1) - 1
    share = (float(y.sum()) + 0.5) / (len(y) + 1.0)
    model = {
        "base": np.array([np.log(share / (1 - share))]),
        "feature": np.zeros((0, inner), np.int32), "threshold": np.zeros((0, inner)),
        "value": np.zeros((0, total - inner)), "depth": np.array([depth]),
    }
    if len(set(y.tolist())) < 2:
        return model
    n, k = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(k)]
    binned = np.column_stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(k)])
    score = np.full(n, model["base"][0])
    grown: dict[str, list] = {"feature": [], "threshold": [], "value": []}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        slope, curve = y - p, np.maximum(p * (1 - p), 1e-12)
        feature, threshold = np.zeros(inner, np.int32), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            local = node - first
            best = np.full(width, 1e-6)
            for f in range(k):
                cells = local * bins + binned[:, f]
                g = np.bincount(cells, slope, width * bins).reshape(width, bins)
                h = np.bincount(cells, curve, width * bins).reshape(width, bins)
                c = np.bincount(cells, minlength=width * bins).reshape(width, bins)
                gl, hl, cl = g.cumsum(1), h.cumsum(1), c.cumsum(1)
                ga, ha, ca = gl[:, -1:], hl[:, -1:], cl[:, -1:]
                gain = gl**2 / (hl + ridge) + (ga - gl) ** 2 / (ha - hl + ridge) - ga**2 / (ha + ridge)
                gain[(cl < least) | (ca - cl < least)] = -1
                gain = gain[:, : len(edges[f])]
                if not gain.size:
                    continue
                cut = gain.argmax(1)
                value = gain[np.arange(width), cut]
                better = value > best
                best = np.where(better, value, best)
                feature[first : first + width][better] = f
                threshold[first : first + width][better] = edges[f][cut[better]]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf = node - inner
        value = rate * np.bincount(leaf, slope, total - inner) / (np.bincount(leaf, curve, total - inner) + ridge)
        score = score + value[leaf]
        for name, part in (("feature", feature), ("threshold", threshold), ("value", value)):
            grown[name].append(part)
    return model | {name: np.stack(parts) for name, parts in grown.items()}


def scores(model: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Probability of label 1 for each row: all rows and trees go down a level together."""
    trees = np.arange(len(model["feature"]))
    node = np.zeros((len(x), len(trees)), np.int64)
    rows = np.arange(len(x))[:, None]
    for _ in range(int(model["depth"][0])):
        node = 2 * node + 1 + (x[rows, model["feature"][trees, node]] > model["threshold"][trees, node])
    leaf = node - model["feature"].shape[1]
    return 1 / (1 + np.exp(-(model["base"][0] + model["value"][trees, leaf].sum(1))))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [statistics(text) for text in raw_texts(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["label", "x"])


def _scorer(model: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(text) for text in raw_texts(batch.column(1))]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(scores(model, x), pa.float64())], ["doc_id", "held_out", "score"]
            )

    return run


def fitted(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> dict[str, np.ndarray]:
    """Trees for ``labels.quality``, from rows that are not held out.

    Takes the ``train_rows`` labelled rows with the smallest id hashes; a label without
    a document, and null or other labels than 0 and 1, are left out.
    """
    own = labels.select("doc_id", F.col("quality").cast("int").alias("label"))
    own = own.filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(train_rows)
    rows = docs.select("doc_id", "text").join(own, "doc_id").select("label", "text")
    found = rows.mapInArrow(_features, "label int, x array<double>").toPandas()
    x = np.array(found["x"].tolist(), float).reshape(-1, len(FEATURES))
    y = found["label"].to_numpy(float)
    order = np.lexsort([*x.T, y])  # the order of arrival must not show
    return fit_trees(x[order], y[order])


def held_out():
    """True for the fifth of the ids whose checksum leaves no remainder; a null id is not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def classified(docs: DataFrame, labels: DataFrame, cut: float = 0.3, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, score, predicted``.

    - Null and empty texts are scored from their zero statistics.
    - Without usable labels every score is one half.
    - Repeated rows score alike. Other columns do not take part. Empty table: empty result.
    """
    model = fitted(docs, labels, train_rows)
    rows = docs.select("doc_id", "text", held_out().alias("held_out"))
    scored = rows.mapInArrow(_scorer(model), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= cut).cast("int"))
