"""Quality by hierarchical empirical Bayes: document evidence and site and path priors.

A logistic classifier on a bounded labelled sample turns each whole text into log-odds.
Grouped sums of its probabilities give every path (within a site) and every site a rate,
shrunk towards the level above by as many pseudo-documents as the spread between groups
warrants; sparse sites thus fall back on the global rate. A document's posterior is its
likelihood ratio times the odds of its path, of whose rate its own probability is left out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagveil.llm.common import as_rows, chunks, give_back, map_arrow, resident, stored, sub_batches, texts_of
from tagveil.llm.url_filter import host_of, path_of

#: Labelled documents that the classifier is fitted on at most, chosen by a hash of their id.
SAMPLE = 10_000
#: Word features kept per target, by chi-square over the sample, and the fewest documents they occur in.
WORDS, LEAST_DOCS = 400, 5
#: Bytes of the word beginnings that are features, and how many words with one in a text make a feature of their own.
BEGINNINGS, REPEATS = (5, 6, 7, 8, 9), (2, 3)
CACHE_WORDS, CACHED_LENGTH = 200_000, 64
#: Bytes of text whose features are counted together.
COUNT_BYTES = 1 << 20
TARGETS = ("quality", "toxic")
CUT_OFF = 0.5
#: Bounds of the pseudo-documents that a group's prior is worth.
LEAST_WEIGHT, MOST_WEIGHT = 5.0, 1e6
#: A document's evidence is held within these log-odds, so that no single one is certain.
MOST_EVIDENCE = 12.0

_BLANKS = bytes(i if i >= 128 or chr(i).isalnum() else 32 for i in range(256))
_UPPER, _DIGITS, _MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!?#$%&*|<>{}[]=_~^"
N_DENSE = 9


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(_BLANKS).split()


def word_features(distinct: set[bytes]) -> set[bytes]:
    """A text's words, their beginnings, and beginnings that several of its words share."""
    begun = Counter(w[:k] for w in distinct for k in BEGINNINGS if len(w) > k)
    return {b"=" + w for w in distinct} | {b"^" + w for w in begun} | {b"%d^%s" % (n, w) for w, have in begun.items() if have > 1 for n in REPEATS if have >= n}


def dense(text: bytes, words: list[bytes], distinct: int) -> list[float]:
    """Shape of a text: shares of capitals, digits, marks, repeats; distinct words; lengths."""
    size, n = len(text) + 1, len(words) + 1
    repeated = sum(map(bytes.__eq__, words, words[1:])) if n > 2 else 0
    pieces = len(text.split())
    return [
        (size - 1 - len(text.translate(None, _UPPER))) / size,
        (size - 1 - len(text.translate(None, _DIGITS))) / size,
        (size - 1 - len(text.translate(None, _MARKS))) / size,
        repeated / n,
        distinct / n**0.9,
        np.log(n),
        np.log(size / n),
        text.count(b"\n") / n,
        pieces / n,
    ]


@dataclass
class Classifier:
    words: list[bytes]
    mean: np.ndarray
    scale: np.ndarray
    #: One row per target: bias, dense weights, word weights.
    weights: np.ndarray
    base: np.ndarray

    def __post_init__(self):
        self.at = {w: i for i, w in enumerate(self.words)}
        self.memory: dict[bytes, tuple[bytes, ...]] = {}
        self.begun = {w.partition(b"^")[2] for w in self.words if w[:1] != b"="}

    def _parts(self, word: bytes) -> tuple[bytes, ...]:
        """The word's features of which the model knows any form."""
        return (*((b"=" + word,) if b"=" + word in self.at else ()), *(b"^" + word[:k] for k in BEGINNINGS if len(word) > k and word[:k] in self.begun))

    def hits(self, distinct: set[bytes]) -> list[int]:
        """Indices of the known features of a text, as ``word_features`` has them."""
        memory, parts = self.memory, []
        if len(memory) > CACHE_WORDS:
            memory.clear()
        for word in distinct:
            got = memory.get(word)
            if got is None:
                got = self._parts(word)
                if len(word) <= CACHED_LENGTH:
                    memory[word] = got
            if got:
                parts += got
        counts = Counter(parts)
        found = [self.at.get(x) for x in counts] + [self.at.get(b"%d%s" % (n, x)) for x, have in counts.items() if have > 1 for n in REPEATS if have >= n]
        return [x for x in found if x is not None]

    def evidence(self, texts: list[bytes]) -> np.ndarray:
        """Log-likelihood ratios (texts x targets): log-odds less those of the sample's rate."""
        rows, hits, where = np.zeros((len(texts), N_DENSE)), [], []
        for i, text in enumerate(texts):
            words = words_of(text)
            distinct = set(words)
            rows[i] = dense(text, words, len(distinct))
            got = self.hits(distinct)
            hits += got
            where += [i] * len(got)
        x = (rows - self.mean) / self.scale
        out = self.weights[:, 0] + x.clip(-5, 5) @ self.weights[:, 1 : 1 + N_DENSE].T
        if hits:
            for t in range(len(self.weights)):
                out[:, t] += np.bincount(where, self.weights[t, 1 + N_DENSE :][hits], minlength=len(texts))
        return (out - self.base).clip(-MOST_EVIDENCE, MOST_EVIDENCE)


def _fit_one(x: np.ndarray, y: np.ndarray, ridge: float = 2e-4, rounds: int = 25) -> np.ndarray:
    """Ridge logistic regression by Newton steps; columns are few."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge * len(x))
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(x @ w).clip(-30, 30)))
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-4:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier:
    """Fit on at most ``sample`` labelled documents; a label that is null in either target is not used.

    An id that is labelled more than once counts once where its labels agree, and not at all
    where they contradict each other, so the order of the rows is no matter.
    Documents without a text count as empty ones. Without labels everything is judged by
    the priors alone (all weights zero).
    """
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(t).cast("int").alias(t) for t in TARGETS)).dropna()
    agreed = chosen.groupBy("doc_id").agg(*(F.min(t).alias(t) for t in TARGETS), *(F.max(t).alias(f"most_{t}") for t in TARGETS))
    chosen = agreed.where(" and ".join(f"{t} = most_{t}" for t in TARGETS)).select("doc_id", *TARGETS)
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id"))

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident("nothing", dict)
        for batch in sub_batches(batches, limit=COUNT_BYTES):
            sums: dict[bytes, int] = {}
            for text, *marks in zip(texts_of(batch), *(batch.column(t).to_pylist() for t in TARGETS), strict=True):
                kind = 1 + marks[0] + 2 * marks[1]
                for x in word_features(set(words_of(text))):
                    sums[x] = sums.get(x, 0) + (1 << 16 * (kind - 1))  # four counts in one number
            packed = np.array([[v >> 16 * k & 0xFFFF for k in range(4)] for v in sums.values()], np.int64).reshape(-1, 4)
            columns = packed.sum(1), packed[:, 1] + packed[:, 3], packed[:, 2] + packed[:, 3]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.binary()), *map(pa.array, columns)], names=["word", "df", *TARGETS])

    labelled = texts.agg(F.count("*").alias("n"), *(F.sum(t).alias(t) for t in TARGETS)).first()
    n = labelled.n
    if not n:
        zero = np.zeros((len(TARGETS), 1 + N_DENSE))
        return Classifier([], np.zeros(N_DENSE), np.ones(N_DENSE), zero, np.zeros(len(TARGETS)))
    found = map_arrow(texts, distinct, "word binary, df long, quality long, toxic long").groupBy("word").agg(F.sum("df").alias("df"), *(F.sum(t).alias(t) for t in TARGETS)).where(F.col("df") >= LEAST_DOCS)
    words: dict[bytes, None] = {}
    for t in TARGETS:
        rate = labelled[t] / n
        chi = F.pow(F.col(t) - F.col("df") * rate, 2) / (F.col("df") * (rate * (1 - rate) + 1e-9) * (1 - F.col("df") / (n + 1)))
        words |= dict.fromkeys(bytes(r.word) for r in found.orderBy(chi.desc(), "word").limit(WORDS).collect())
    names = list(words)
    finder = Classifier(names, *[np.zeros(0)] * 4)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches):
            rows, hits = [], []
            for text in texts_of(batch):
                own = words_of(text)
                unique = set(own)
                rows.append(dense(text, own, len(unique)))
                hits.append(finder.hits(unique))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(batch.column(t) for t in TARGETS), pa.array(rows, pa.list_(pa.float64())), pa.array(hits, pa.list_(pa.int32()))], names=["doc_id", *TARGETS, "x", "hits"])

    rows = map_arrow(texts, vectors, "doc_id long, quality int, toxic int, x array<double>, hits array<int>").orderBy("doc_id", "x").collect()
    x = np.array([r.x for r in rows])
    mean, scale = x.mean(0), x.std(0) + 1e-6
    full = np.zeros((len(rows), 1 + N_DENSE + len(names)))
    full[:, 0], full[:, 1 : 1 + N_DENSE] = 1, ((x - mean) / scale).clip(-5, 5)
    for i, r in enumerate(rows):
        full[i, [1 + N_DENSE + h for h in r.hits]] = 1
    weights, base = [], []
    for t in TARGETS:
        y = np.array([r[t] for r in rows], float)
        weights.append(_fit_one(full, y))
        rate = (y.sum() + 0.5) / (len(y) + 1)
        base.append(np.log(rate / (1 - rate)))
    return Classifier(names, mean, scale, np.array(weights), np.array(base))


def with_evidence(docs: DataFrame, model: Classifier, text: str = "text") -> DataFrame:
    """``docs`` with an array column of the targets' log-likelihood ratios; the text stays in the JVM row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("array<double>")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        resident("nothing", dict)
        for texts in batches:
            parts = [shared.value.evidence(part) for part in chunks(texts)]
            found = np.concatenate(parts) if parts else np.zeros((0, len(TARGETS)))
            yield pa.array(found.tolist(), pa.list_(pa.float64()))
            give_back()

    return docs.withColumn("_evidence", judge(F.col(text)))


def _rate(evidence: Column, base: float) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(evidence + F.lit(float(base)))))


def group_rates(judged: DataFrame, model: Classifier, site: Column, path: Column) -> DataFrame:
    """(site, path, one shrunk rate per target and level, and what the rates are made of): partial sums first, so a hot site is no matter."""
    sums = [F.sum(_rate(F.col("_evidence")[i], model.base[i])).alias(f"s_{t}") for i, t in enumerate(TARGETS)]
    paths = stored(judged.groupBy(site.alias("_site"), path.alias("_path")).agg(F.count("*").cast("double").alias("n"), *sums))
    sites = stored(paths.groupBy("_site").agg(F.sum("n").alias("n"), *(F.sum(f"s_{t}").alias(f"s_{t}") for t in TARGETS)))
    total = sites.agg(F.sum("n").alias("n"), *(F.sum(f"s_{t}").alias(f"s_{t}") for t in TARGETS)).first()
    rate = {t: ((total[f"s_{t}"] or 0) + 0.5) / ((total.n or 0) + 1) for t in TARGETS}

    def weight(groups: DataFrame, t: str, above: Column) -> float:
        """Pseudo-documents by moments: within-group variance over the variance between groups beyond chance."""
        p = F.col(f"s_{t}") / F.col("n")
        inside = above * (1 - above)
        got = groups.agg(F.sum(F.col("n") * (p - above) ** 2).alias("between"), F.sum(inside).alias("chance"), F.sum("n").alias("n"), F.sum(F.col("n") * inside).alias("inside")).first()
        if not got.n or not got.inside:
            return MOST_WEIGHT
        between = (got.between - got.chance) / got.n
        return MOST_WEIGHT if between <= 0 else min(MOST_WEIGHT, max(LEAST_WEIGHT, got.inside / got.n / between))

    for t in TARGETS:
        k = weight(sites, t, F.lit(rate[t]))
        sites = sites.withColumns({f"site_{t}": (F.col(f"s_{t}") + k * rate[t]) / (F.col("n") + k), f"site_k_{t}": F.lit(k), f"all_s_{t}": F.lit(float(total[f"s_{t}"] or 0))})
    sites = sites.withColumn("all_n", F.lit(float(total.n or 0)))
    of_site = [F.col("n").alias("site_n"), "all_n", *(F.col(f"s_{t}").alias(f"site_s_{t}") for t in TARGETS), *(f"{c}_{t}" for t in TARGETS for c in ("site", "site_k", "all_s"))]
    joined = stored(paths.join(sites.select(F.col("_site").alias("_of"), *of_site), F.col("_site").eqNullSafe(F.col("_of"))).drop("_of"))
    for t in TARGETS:
        k = weight(joined, t, F.col(f"site_{t}"))
        joined = joined.withColumns({f"path_{t}": (F.col(f"s_{t}") + k * F.col(f"site_{t}")) / (F.col("n") + k), f"path_k_{t}": F.lit(k)})
    return stored(joined)


def _without(level: str, t: str, own: Column, above: Column) -> Column:
    """A level's rate without the document's own probability, shrunk towards that of the level above."""
    n, k = F.col("_n" if level == "path" else "_site_n"), F.col(f"_{level}_k_{t}")
    s = F.greatest(F.lit(0.0), F.col(f"_s_{t}" if level == "path" else f"_site_s_{t}") - own)
    return (s + k * above) / (n - 1 + k)


def with_posteriors(judged: DataFrame, rates: DataFrame, model: Classifier, site: Column, path: Column) -> DataFrame:
    """Add site and path rates, the posteriors ``_p_<target>`` and the decision ``_keep``.

    Were a document's own evidence in its path's rate as well, it would count twice, most of
    all in small groups; so every level's rate is taken without it.
    """
    rates = rates.select(*(F.col(c).alias(f"_{c}" if c[0] != "_" else f"_g{c}") for c in rates.columns))
    out = judged.join(rates, site.eqNullSafe(F.col("_g_site")) & path.eqNullSafe(F.col("_g_path")), "left")
    for i, t in enumerate(TARGETS):
        own = _rate(F.col("_evidence")[i], model.base[i])
        above = (F.greatest(F.lit(0.0), F.col(f"_all_s_{t}") - own) + 0.5) / F.col("_all_n")
        prior = _without("path", t, own, _without("site", t, own, above))
        out = out.withColumn(f"_p_{t}", F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("_evidence")[i] + F.log(prior / (1 - prior))))))
    return out.withColumn("_keep", (F.col("_p_quality") >= CUT_OFF) & (F.col("_p_toxic") < CUT_OFF))


def places(docs: DataFrame, at: str = "") -> tuple[Column, Column]:
    """Site and path of a document: its url's host and first folder, or, where the table has no urls, its source and language."""
    if "url" in docs.columns:
        url = F.col(f"{at}url").cast("string")
        return host_of(url), F.regexp_extract(path_of(url), r"^/([^/]*)/", 1)
    return F.col(f"{at}source").cast("string"), F.col(f"{at}lang").cast("string")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Posterior quality and toxicity of every document, with its site's and path's rates.

    Null texts count as empty; null sites and paths are groups of their own; a null doc_id
    is judged like any; repeated rows count and return each time; a posterior of exactly the
    cut-off keeps; a very long text is read whole; an empty table gives no row; columns
    besides doc_id, text, and url, or else source and lang, are not looked at.
    """
    site, path = places(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", site.alias("source"), path.alias("lang"))
    model = fit(docs, labels)
    site, path = F.col("source"), F.col("lang")
    judged = stored(with_evidence(docs, model).drop("text"))
    found = with_posteriors(judged, group_rates(judged, model, site, path), model, site, path)
    return found.select("doc_id", "source", "lang", *(F.col(f"_{x}_{t}").alias(f"{x}_{t}") for t in TARGETS for x in ("site", "path", "p")), F.col("_keep").alias("keep"))


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns (names may clash with any of ours). The text is judged twice instead of being stored.

    Null, empty and very long texts, null ids, sites and paths, repeated rows and an empty
    table are as in ``judge``.
    """
    model = fit(docs, labels)
    judged = with_evidence(as_rows(docs), model, "_row.text")
    site, path = places(docs, "_row.")
    rates = group_rates(judged, model, site, path)
    return with_posteriors(judged, rates, model, site, path).where("_keep").select("_row.*")
