"""Operator 6: document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad. The field's potentials are a linear score
of the line's own features and those of the lines before and after it, and a
weight for each pair of neighbouring labels. Forward-backward gives each
line's marginal probability of being good; the mean of these, weighted by line
length, is the document's quality, and a logistic curve fitted on the training
documents turns it into the score.

Only whole documents carry labels, so in training a document's label stands for
each of its lines. What is climbed is the mean over the training documents of
their labelling's log likelihood, each divided by its number of lines so that
every document counts once, less L2 / 2 times the squares of all weights
(``objective``).

Fitted on a bounded sample: ``TRAIN_PER_CLASS`` labelled documents of each
class at most, the first by a seeded hash of the id, of ``TRAIN_CHARS``
characters at most each and ``SAMPLE_CHARS`` together; a row that is given twice
counts once. Scoring takes every document and every line whole.
Labels, language, source and id are no inputs.

Defined results: a null or empty text is one empty line; equal texts have
equal scores; documents without labels are scored like any other; without
usable labels every score is 0.5; with one class the score leans to it; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryline.llm.shared import fold_of, releasing

FOLDS, HELD_OUT = 3, 1
TRAIN_PER_CLASS, TRAIN_CHARS, SEED = 2000, 200_000, 42
#: Characters of the whole sample at most.
SAMPLE_CHARS = 40_000_000
STEPS, RATE, L2 = 150, 0.1, 1e-3

UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
DIGITS = b"0123456789"
MARKS = b"#*$%&<>@^~_=+\\/{}[]"
STOPS = b".,;:!?"
#: Features of one line; see ``line_features``.
N_FEATURES = 14


# ---------------------------------------------------------------- features


def line_features(data: bytes):
    """(features of each line, length of each line) of a UTF-8 text; lines end at \\n."""
    import numpy as np

    rows, lengths, seen = [], [], set()
    for line in data.split(b"\n"):
        words = line.split()
        n, size = len(words), len(line)
        lengths.append(size)
        if not n:
            rows.append((1.0, *([0.0] * (N_FEATURES - 1))))
            continue
        letters = size - len(line.translate(None, LETTERS))
        upper = size - len(line.translate(None, UPPER))
        marks = size - len(line.translate(None, MARKS))
        again = sum(map(bytes.__eq__, words, words[1:]))
        rows.append(
            (
                0.0,
                min(n, 50) / 50,
                float(n < 4),
                min(letters / n, 20) / 20,
                1 - letters / size,
                upper / max(letters, 1),
                (size - len(line.translate(None, DIGITS))) / size,
                min(marks / n, 3),
                min(line.count(b"!") / n, 2),
                min(line.count(b"|") / n, 2),
                min((size - len(line.translate(None, STOPS))) / n, 3),
                1 - len(set(words)) / n,
                again / n,
                float(line in seen),
            )
        )
        seen.add(line)
    return np.array(rows, dtype=np.float64), np.array(lengths, dtype=np.float64)


def with_neighbours(x, firsts, lasts):
    """Each line's features with those of the lines before and after it, and a constant; nothing beyond the ends."""
    import numpy as np

    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[firsts], after[lasts] = 0, 0
    return np.concatenate([x, before, after, np.ones((len(x), 1))], axis=1)


# ---------------------------------------------------------------- the field


def marginals(scores, starts, lengths, link, weight=None):
    """P(good) of each line, the pair marginals summed over all chains (times the weight of the later line), and each chain's log partition function.

    scores: the log potential of good against bad of each line; starts and
    lengths: where each chain lies, longest first; link: the 2 x 2 log
    potentials of neighbouring labels (bad, good). All chains advance together.
    """
    import numpy as np

    unary = np.stack([np.zeros_like(scores), scores], axis=1)
    forward, backward = np.empty_like(unary), np.zeros_like(unary)
    top = int(lengths[0]) if len(lengths) else 0
    live = [starts[: np.searchsorted(-lengths, -t, side="left")] + t for t in range(top)]  # chains longer than t
    forward[starts] = unary[starts]
    for t in range(1, top):
        now = live[t]
        forward[now] = unary[now] + np.logaddexp(forward[now - 1, :1] + link[:1], forward[now - 1, 1:] + link[1:])
    for t in range(top - 2, -1, -1):
        now = live[t + 1] - 1
        ahead = unary[now + 1] + backward[now + 1]
        backward[now] = np.logaddexp(link[:, 0] + ahead[:, :1], link[:, 1] + ahead[:, 1:])
    ends = starts + lengths - 1
    total = np.logaddexp(forward[ends, 0], forward[ends, 1])
    of = np.empty(len(scores))
    of[starts] = total
    for t in range(1, top):
        of[live[t]] = of[live[t] - 1]
    both = np.zeros((2, 2))
    later = np.ones(len(scores), dtype=bool)
    later[starts] = False
    later = np.nonzero(later)[0]
    if weight is not None and len(later):
        for a in range(2):
            for b in range(2):
                both[a, b] = weight[later] @ np.exp(forward[later - 1, a] + link[a, b] + unary[later, b] + backward[later, b] - of[later])
    return np.exp(forward[:, 1] + backward[:, 1] - of), both, total


def objective(w, link, x, gold, lengths):
    """What ``fit`` climbs, and its slopes by w and by link: x and gold (0 or 1) of all lines, document by document of so many lines."""
    import numpy as np

    order, starts = chains(lengths)
    begins = np.cumsum(lengths) - lengths
    weight = np.repeat(1 / lengths, lengths) / len(lengths)
    scores = x @ w
    p, both, total = marginals(scores, starts, lengths[order], link, weight)
    later = np.ones(len(x), dtype=bool)
    later[begins] = False
    later = np.nonzero(later)[0]
    same = np.zeros((2, 2))
    np.add.at(same, (gold[later - 1].astype(int), gold[later].astype(int)), weight[later])
    value = weight @ (gold * scores) + (same * link).sum() - (total / lengths[order]).sum() / len(lengths) - L2 / 2 * ((w**2).sum() + (link**2).sum())
    return value, x.T @ (weight * (gold - p)) - L2 * w, same - both - L2 * link


def chains(lengths):
    """(order, starts): chains longest first, and where each of them starts among the lines."""
    import numpy as np

    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    order = np.argsort(-lengths, kind="stable")
    return order, starts[order]


def document_quality(p, sizes, starts, lengths):
    """The mean of the lines' marginals, weighted by length + 1."""
    import numpy as np

    weight = sizes + 1
    return np.add.reduceat(p * weight, starts) / np.add.reduceat(weight, starts)


def fit(documents: list[tuple[bytes, int]]) -> dict:
    """The model's weights from (text, label) of the training documents: gradient ascent on the regularised log likelihood."""
    import numpy as np

    model = {"w": np.zeros(3 * N_FEATURES + 1), "link": np.zeros((2, 2)), "curve": (0.0, 0.0)}
    if not documents:
        return model
    found = [line_features(text) for text, _ in documents]
    labels = np.array([label for _, label in documents], dtype=np.float64)
    lengths = np.array([len(x) for x, _ in found], dtype=np.int64)
    order, starts = chains(lengths)
    begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    x = with_neighbours(np.concatenate([f for f, _ in found]), begins, begins + lengths - 1)
    gold = np.repeat(labels, lengths)
    w, link = model["w"], model["link"]
    moment = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(link), np.zeros_like(link)]
    for step in range(1, STEPS + 1):
        _, by_w, by_link = objective(w, link, x, gold, lengths)
        for k, (value, slope) in enumerate(((w, by_w), (link, by_link))):
            m, v = moment[2 * k], moment[2 * k + 1]
            m += 0.1 * (slope - m)
            v += 0.01 * (slope**2 - v)
            value += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    p, _, _ = marginals(x @ w, starts, lengths[order], link)
    sizes = np.concatenate([s for _, s in found])
    z = logit(document_quality(p, sizes, begins, lengths))
    a, b = 1.0, 0.0
    for _ in range(200):  # the logistic curve, by regularised Newton steps
        q = sigmoid(a * z + b)
        g = np.array([z @ (q - labels) + 1e-2 * (a - 1), (q - labels).sum() + 1e-2 * b])
        h = q * (1 - q)
        hess = np.array([[z @ (h * z) + 1e-2, z @ h], [z @ h, h.sum() + 1e-2]])
        d = np.linalg.solve(hess + 1e-6 * np.eye(2), g)
        d *= min(1.0, 1.0 / max(np.abs(d).max(), 1e-12))
        a, b = a - d[0], b - d[1]
    model["curve"] = (float(a), float(b))
    return model


def logit(q):
    import numpy as np

    q = np.clip(q, 1e-6, 1 - 1e-6)
    return np.log(q / (1 - q))


def sigmoid(z):
    import numpy as np

    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def score_texts(texts: list[bytes], model: dict):
    """The score of each text."""
    import numpy as np

    if not texts:
        return np.zeros(0)
    found = [line_features(text) for text in texts]
    lengths = np.array([len(x) for x, _ in found], dtype=np.int64)
    order, starts = chains(lengths)
    begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    x = with_neighbours(np.concatenate([f for f, _ in found]), begins, begins + lengths - 1)
    p, _, _ = marginals(x @ model["w"], starts, lengths[order], model["link"])
    a, b = model["curve"]
    return sigmoid(a * logit(document_quality(p, np.concatenate([s for _, s in found]), begins, lengths)) + b)


# ---------------------------------------------------------------- Spark


def training_sample(docs: DataFrame, labels: DataFrame, *, per_class=TRAIN_PER_CLASS, max_chars=TRAIN_CHARS, held_out: bool = True) -> list[tuple[bytes, int]]:
    """The bounded sample, on the driver: per_class documents of each label at most."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    if held_out:
        known = known.where(fold_of(F.col("doc_id"), FOLDS) != HELD_OUT)
    first = lambda label: known.where(F.col("quality") == label).orderBy(F.xxhash64(F.lit(SEED), F.col("doc_id")), "doc_id").limit(per_class)
    chosen = F.broadcast(first(0).union(first(1)))  # 2 * per_class rows at most
    order = [F.xxhash64(F.lit(SEED), F.col("doc_id")), "doc_id", "h"]
    known_texts = docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n"), F.xxhash64("text").alias("h")).where(F.col("n") <= max_chars)
    narrow = known_texts.join(chosen, "doc_id").select("doc_id", "h", "n").distinct().orderBy(*order).limit(2 * per_class)
    upto = Window.partitionBy().orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)  # over those rows
    kept = F.broadcast(narrow.withColumn("sum", F.sum("n").over(upto)).where(F.col("sum") <= SAMPLE_CHARS).select("doc_id", "h"))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).join(kept, ["doc_id", "h"]).join(chosen, "doc_id")
    rows = rows.groupBy("doc_id", "h").agg(F.first("text").alias("text"), F.first("quality").alias("quality")).orderBy(*order)
    return [((r["text"] or "").encode("utf-8", "replace"), r["quality"]) for r in rows.collect()]


def train(docs: DataFrame, labels: DataFrame, **options) -> dict:
    return fit(training_sample(docs, labels, **options))


def score(docs: DataFrame, model: dict, *, keep: tuple[str, ...] = ("doc_id",), score_col: str = "__score") -> DataFrame:
    """The columns ``keep`` of ``docs`` and ``score_col``, which is none of them, for each row."""
    names = [*keep, *(() if "text" in keep else ("text",))]
    at = names.index("text")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [x or b"" for x in batch.column(at).cast(pa.binary()).to_pylist()]
            out = []
            for a in range(0, len(texts), 256):
                out += score_texts(texts[a : a + 256], model).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(out, type=pa.float64())], names=[*keep, score_col])

    kept = docs.select(*names)
    return kept.mapInArrow(releasing(run), kept.select(*keep, F.lit(0.0).alias(score_col)).schema)


def op6_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))
