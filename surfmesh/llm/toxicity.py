"""Toxicity: a two-label linear-chain conditional random field over words, summed up to spans and document scores.

Labels exist for documents only, so words are labelled first: a word form or word beginning that stands out in toxic documents (by a
likelihood-ratio test against the clean ones of the sample) marks its words as toxic; a second and third look at the toxic documents
that are still unexplained finds rarer ones. The field is then trained on these word labels, and forward-backward marginals of each text
are summed up: expected toxic words, their share, the highest marginals. A logistic model of those sums, fitted on the same sample, gives the score.

Training reads at most `sample` labelled documents (a documented bound, spread by hash over the rows that may be learnt from), each
whole, however long: executors reduce it to its distinct words and their places, and the driver goes through these some CHUNK words at a
time. Everything else covers all words of all texts.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surfmesh.llm.common import arrow_schema, cut, map_arrow

#: Most labelled documents that training reads. Scoring has no such bound.
SAMPLE = 2400
#: Words that training holds marginals of at once (a longer text makes a chunk of its own).
CHUNK = 1 << 17
_WORD = re.compile(r"[^\W_]+")
_PREFIXES = range(3, 9)
_CACHE = 200_000
#: What is taken off each word's marginal before they are summed: else the faint doubts of a long text would add up.
_DOUBT = 0.1
#: Words of a lane of the forward-backward sweep, and what a lane's start may leave out of a message (a log-odds).
_LANE, _EXACT = 256, 1e-13


def lowered(text: str) -> str:
    """text in lower case, letter by letter, so that offsets stay (the few letters that would grow are left as they are)."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def words_of(text: str) -> list[str]:
    return _WORD.findall(lowered(text))


def features_of(word: str) -> list[str]:
    """The word itself and its beginnings. Nothing but the characters of the text is looked at."""
    return ["=" + word, *(word[:k] for k in _PREFIXES if k < len(word)), *([word] if len(word) in _PREFIXES else ())]


def _g2(a: int, b: int, n1: int, n0: int) -> float:
    """The likelihood ratio of a feature in a of n1 toxic and b of n0 clean documents; 0 unless it is commoner in the toxic ones."""
    if a * n0 <= b * n1:
        return 0.0
    n, k, out = n1 + n0, a + b, 0.0
    for seen, due in ((a, k * n1 / n), (b, k * n0 / n), (n1 - a, (n - k) * n1 / n), (n0 - b, (n - k) * n0 / n)):
        if seen > 0 and due > 0:
            out += seen * math.log(seen / due)
    return 2 * out


def reduced(text: str) -> tuple[list[str], np.ndarray]:
    """The distinct words of a text, and the text as places in that list."""
    known: dict[str, int] = {}
    places = np.fromiter((known.setdefault(w, len(known)) for w in words_of(text)), dtype=np.int32)
    return list(known), places


class Vocabulary:
    """Word types of the sample, their features, and how often each occurs: all as numbers."""

    def __init__(self, texts: Iterable[tuple[list[str], np.ndarray]]):
        self.words: dict[str, int] = {}
        self.features: dict[str, int] = {}
        own, sizes = array("i"), array("i")
        self.docs: list[np.ndarray] = []
        for types, places in texts:
            ids = array("i")
            for w in types:
                if (k := self.words.get(w)) is None:
                    k = self.words[w] = len(self.words)
                    fs = features_of(w)
                    own.extend(self.features.setdefault(f, len(self.features)) for f in fs)
                    sizes.append(len(fs))
                ids.append(k)
            self.docs.append(np.array(ids, dtype=np.int32)[places])
        self.col = np.array(own, dtype=np.int32)
        self.ends = np.cumsum(np.array(sizes, dtype=np.int64))
        self.bags = [self._bag(d) for d in self.docs]

    def _bag(self, doc: np.ndarray) -> np.ndarray:
        types = np.unique(doc)
        if not len(types):
            return types
        lo, hi = np.where(types > 0, self.ends[types - 1], 0), self.ends[types]
        return np.unique(self.col[np.repeat(lo - np.concatenate([[0], np.cumsum(hi - lo)[:-1]]), hi - lo) + np.arange((hi - lo).sum())])

    def documents(self, bags: list[np.ndarray]) -> np.ndarray:
        """In how many of these each feature occurs."""
        out = np.zeros(len(self.features), dtype=np.int64)
        for bag in bags:
            out[bag] += 1
        return out


def seed_features(bags: list[np.ndarray], toxic: list[bool], clean: np.ndarray, vocabulary: Vocabulary, rounds: int = 4) -> np.ndarray:
    """A mark for each feature whose words count as toxic: strongly tied to toxic documents, rare in clean ones, found round by round."""
    n0 = len(toxic) - sum(toxic)
    left, seeds = [b for b, y in zip(bags, toxic, strict=True) if y], np.zeros(len(clean), dtype=bool)
    for _ in range(rounds):
        n1 = len(left)
        if n1 < 5 or not n0:
            break
        seen = vocabulary.documents(left)
        bar = 2 * math.log(max(np.count_nonzero(seen), 2)) + 6
        likely = np.flatnonzero((seen >= 4) & (seen * n0 >= 6 * clean * n1) & ~seeds)
        strong = [f for f in likely if _g2(int(seen[f]), int(clean[f]), n1, n0) >= bar]
        if not strong:
            break
        seeds[strong] = True
        left = [b for b in left if not seeds[b].any()]
    return seeds


@dataclass(frozen=True)
class Model:
    """weights: by feature, of the toxic label against the clean one. trans[i][j]: from label i to j. doc: of the sums (bias first)."""

    weights: dict[str, float]
    bias: float
    trans: tuple[tuple[float, float], tuple[float, float]]
    doc: tuple[float, ...]

    def emission(self, word: str) -> float:
        get = self.weights.get
        return self.bias + sum(get(f, 0.0) for f in features_of(word))


def warm_up(trans: np.ndarray) -> int:
    """Steps after which two messages differ by no more than _EXACT, whatever they started from.

    A step of the sweep shrinks differences of log-odds by tanh(d / 4) at least and leaves d at most (Birkhoff's contraction; emissions move
    both alike), d being the log of the transitions' cross ratio.
    """
    d = abs(float(trans[0][0] + trans[1][1] - trans[0][1] - trans[1][0]))
    shrink = math.tanh(d / 4)
    if d <= _EXACT or shrink <= 0:
        return 1
    return 1 + math.ceil(math.log(_EXACT / d) / math.log(shrink)) if shrink < 1 else 1 << 62


def marginals(emit: np.ndarray, first: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over the texts laid end to end; first marks each text's first word.

    Returns P(toxic) of each word and both messages, as log-odds. A two-label message is one number: its log-odds. Words are dealt in
    lanes that are swept side by side, each lane behind a warm-up of the words before it, as long as the transition's contraction asks for;
    where that is longer than all the words, one lane holds them all. So a text's marginals don't depend on what lies beside it.
    """
    n = len(emit)
    trans = np.clip(trans, -20, 20)
    (t00, t01), (t10, t11) = trans
    if not n:
        return emit, emit, emit
    warm = warm_up(trans)
    wide, warm = (_LANE, warm) if warm < max(n, _LANE) else (n, 0)
    lanes = -(-n // wide)
    at = np.arange(lanes) * wide

    def sweep(e: np.ndarray, start: np.ndarray, into: tuple[float, float, float, float]) -> np.ndarray:
        # odds of label 1 before each word, from the odds x of the word before with its own emission: (c01 + c11 x) / (c00 + c10 x)
        c00, c01, c10, c11 = np.exp(into)
        pad = np.ones(warm + lanes * wide)
        pad[warm : warm + n] = np.exp(np.clip(e, -60, 60))
        cut = np.ones(warm + lanes * wide, dtype=bool)
        cut[warm : warm + n] = start
        out = np.empty((wide, lanes))
        x = np.ones(lanes)
        for k in range(warm + wide):
            x = (c01 + c11 * x) / (c00 + c10 * x)
            x[cut[at + k]] = 1.0
            if k >= warm:
                out[k - warm] = x
            x = x * pad[at + k]
        return np.log(out).T.reshape(-1)[:n]

    ahead = sweep(emit, first, (t00, t01, t10, t11))
    last = np.append(first[1:], True)
    back = sweep(emit[::-1], last[::-1], (t00, t10, t01, t11))[::-1]
    z = np.clip(ahead + emit + back, -700, 700)
    return 1 / (1 + np.exp(-z)), ahead, back


def sums_of(p: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """What the document model sees of each text: 1, log expected toxic words, their share, the highest and the second highest marginal."""
    out = np.zeros((len(sizes), 5))
    out[:, 0] = 1
    some = sizes > 0
    if some.any():
        at = starts[some]
        total = np.add.reduceat(np.maximum(p - _DOUBT, 0), at)
        top = np.maximum.reduceat(p, at)
        owner = np.repeat(np.arange(some.sum()), sizes[some])
        is_top = np.flatnonzero(p == top[owner])
        once = is_top[np.unique(owner[is_top], return_index=True)[1]]
        rest = p.copy()
        rest[once] = 0
        out[some, 1] = np.log1p(total)
        out[some, 2] = np.sqrt(total / sizes[some])
        out[some, 3] = top
        out[some, 4] = np.maximum.reduceat(rest, at)
    return out


def _adam(grad, x: np.ndarray, steps: int, rate: float) -> np.ndarray:
    m, v = np.zeros_like(x), np.zeros_like(x)
    for k in range(1, steps + 1):
        g = grad(x)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return x


def train(texts: list[str], toxic: list[bool], *, share: float | None = None, steps: int = 40, penalty: float = 1e-3) -> Model:
    """The field and the document model from labelled texts; share: of toxic texts where the sample comes from, if it differs.

    Without words that stand out every score is the prior's.
    """
    return learnt(Vocabulary(map(reduced, texts)), toxic, share=share, steps=steps, penalty=penalty)


def chunks_of(sizes: np.ndarray, most: int = CHUNK) -> list[tuple[int, int]]:
    """Runs of texts with at most so many words together, or one text each."""
    out, lo, held = [], 0, 0
    for k, n in enumerate(sizes.tolist()):
        if held and held + n > most:
            out.append((lo, k))
            lo, held = k, 0
        held += n
    return [*out, (lo, len(sizes))] if held else out


def learnt(v: Vocabulary, toxic: list[bool], *, share: float | None = None, steps: int = 40, penalty: float = 1e-3) -> Model:
    """As train(), from reduced texts. The gradient is summed up chunk by chunk, so that memory doesn't grow with it."""
    clean = v.documents([b for b, y in zip(v.bags, toxic, strict=True) if not y])
    seeds = seed_features(v.bags, toxic, clean, v)
    prior = (sum(toxic) + 0.5) / (len(toxic) + 1) if toxic else 0.0
    prior = max(prior, 1e-4)
    true = min(max(prior if share is None else share, 1e-4), 1 - 1e-4)
    if not seeds.any():
        return Model({}, -6.0, ((0.0, 0.0), (0.0, 0.0)), (math.log(true / (1 - true)), 0.0, 0.0, 0.0, 0.0))
    # Words of clean documents are clean, whatever they look like; those of toxic ones are toxic if a seed feature marks them.
    sizes = np.array([len(d) for d in v.docs])
    n, n_types = int(sizes.sum()), len(v.words)
    types = np.repeat(np.arange(n_types), np.diff(v.ends, prepend=0))
    marked = np.bincount(types, weights=seeds[v.col], minlength=n_types) > 0
    used = seeds | (v.documents(v.bags) >= 5)
    rank = np.cumsum(used) - 1
    size, on = int(used.sum()), used[v.col]
    owner, col = types[on], rank[v.col[on]]
    runs = chunks_of(sizes)

    def chunk(lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words of texts lo to hi, which of them are a text's first, and which are toxic."""
        word, own = np.concatenate(v.docs[lo:hi]), sizes[lo:hi]
        head = np.zeros(len(word), dtype=bool)
        head[(np.cumsum(own) - own)[own > 0]] = True
        return word, head, marked[word] & np.repeat(np.array(toxic[lo:hi], dtype=bool), own)

    by_type, total, pairs = np.zeros(n_types), 0, np.zeros((2, 2))
    for lo, hi in runs:
        word, head, y = chunk(lo, hi)
        inner = ~head[1:]
        by_type += np.bincount(word, weights=y, minlength=n_types)
        total += int(y.sum())
        pairs += [[np.sum(inner & (y[:-1] == i) & (y[1:] == j)) for j in (False, True)] for i in (False, True)]
    wanted = np.bincount(col, weights=by_type[owner], minlength=size)

    def emissions(x: np.ndarray) -> np.ndarray:
        return x[size] + np.bincount(owner, weights=x[:size][col], minlength=n_types)

    def grad(x: np.ndarray) -> np.ndarray:
        t, emission = x[size + 1 :].reshape(2, 2), emissions(x)
        due, sum_p, both = np.zeros(n_types), 0.0, np.zeros((2, 2))
        for lo, hi in runs:
            word, head, _ = chunk(lo, hi)
            emit, inner = emission[word], ~head[1:]
            p, ahead, back = marginals(emit, head, t)
            # pairwise marginals from both messages
            left, right = (ahead + emit)[:-1][inner], (back + emit)[1:][inner]
            z = np.stack([np.full_like(left, t[0, 0]), t[0, 1] + right, t[1, 0] + left, t[1, 1] + left + right])
            z -= z.max(axis=0)
            z = np.exp(z)
            both += (z / z.sum(axis=0)).sum(axis=1).reshape(2, 2)
            due += np.bincount(word, weights=p, minlength=n_types)
            sum_p += p.sum()
        g = np.concatenate([np.bincount(col, weights=due[owner], minlength=size) - wanted, [sum_p - total], (both - pairs).reshape(-1)])
        return g / n * 100 + penalty * x

    start = np.concatenate([np.zeros(size), [-3.0], np.zeros(4)])
    x = _adam(grad, start, steps, 0.2)
    weights = {f: float(x[rank[k]]) for f, k in v.features.items() if used[k] and abs(x[rank[k]]) > 1e-3}
    trans, emission = x[size + 1 :].reshape(2, 2), emissions(x)
    sums = np.zeros((len(sizes), 5))
    sums[:, 0] = 1
    for lo, hi in runs:
        word, head, _ = chunk(lo, hi)
        own = sizes[lo:hi]
        sums[lo:hi] = sums_of(marginals(emission[word], head, trans)[0], np.cumsum(own) - own, own)
    target = np.array(toxic, dtype=float)

    def slope(w: np.ndarray) -> np.ndarray:
        return sums.T @ (1 / (1 + np.exp(-np.clip(sums @ w, -50, 50))) - target) / len(target) + 1e-4 * w

    doc = _adam(slope, np.array([math.log(prior / (1 - prior)), 0, 0, 0, 0]), 1500, 0.05)
    doc[0] += math.log(true / (1 - true)) - math.log(prior / (1 - prior))
    return Model(weights, float(x[size]), tuple(map(tuple, trans.tolist())), tuple(doc.tolist()))


REDUCED = "_i long, _y int, types array<string>, places binary"


def fit(docs: DataFrame, labels: DataFrame, *, learn=None, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Trains on at most `sample` labelled rows, those of the smallest hash, of the ids that `learn` (a condition on id_col) admits.

    Rows without an id, a text or a label aren't learnt from. An id labelled twice counts with its higher label, one with several texts with
    the least. Without any labelled row every score is that of a rare label.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias(id_col)).agg(F.max(label_col).alias("_y"))
    known = known.where(learn(F.col(id_col))) if learn else known
    # Both labels stand in the sample: half of its places are the toxic rows' where there are as many.
    places = known.select(id_col, "_y", F.xxhash64(id_col).alias("_h"))
    pick = places.where("_y >= 1").orderBy("_h", id_col).limit(sample // 2).unionByName(places.where("_y < 1").orderBy("_h", id_col).limit(sample // 2))
    texts = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("_text")).where("_text is not null")
    picked = texts.join(F.broadcast(pick), id_col).groupBy(id_col).agg(F.min("_text").alias("_text"), F.max("_y").alias("_y"))
    schema = arrow_schema(REDUCED)

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            held = [reduced(batch.column(2)[i].as_py()) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([t for t, _ in held], schema.field("types").type), pa.array([p.tobytes() for _, p in held], pa.binary())], schema=schema)

    rows = cut(map_arrow(picked.select(F.col(id_col).alias("_i"), F.col("_y").cast("int").alias("_y"), "_text"), stage, REDUCED))
    toxic: list[bool] = []

    def held() -> Iterator[tuple[list[str], np.ndarray]]:
        for r in rows.orderBy("_i").toLocalIterator():
            toxic.append(r["_y"] >= 1)
            yield r["types"], np.frombuffer(r["places"], dtype=np.int32)

    vocabulary = Vocabulary(held())
    share = known.agg(F.avg((F.col("_y") >= 1).cast("double"))).first()[0]
    return learnt(vocabulary, toxic, share=share)


class Scorer:
    """Scores texts batch by batch; one for each task."""

    def __init__(self, model: Model):
        self.model, self.trans, self.doc = model, np.array(model.trans), np.array(model.doc)
        self.cache: dict[str, float] = {}

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The texts' scores, P(toxic) of all their words, and where each text's words start and how many they are."""
        cache, emission = self.cache, self.model.emission
        if len(cache) > _CACHE:
            cache.clear()
        sizes, emit = np.zeros(len(texts), dtype=np.int64), array("d")
        for i, text in enumerate(texts):
            words = words_of(text)
            sizes[i] = len(words)
            for w in words:
                if (e := cache.get(w)) is None:
                    e = cache[w] = emission(w)
                emit.append(e)
        starts = np.cumsum(sizes) - sizes
        first = np.zeros(len(emit), dtype=bool)
        first[starts[sizes > 0]] = True
        p, _, _ = marginals(np.array(emit), first, self.trans)
        return 1 / (1 + np.exp(-np.clip(sums_of(p, starts, sizes) @ self.doc, -50, 50))), p, starts, sizes


OUT = "score double, predicted int, n_toxic_words long, spans array<struct<start:int,end:int>>"


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and the columns of OUT of every row: the score of label 1, and the offsets (in code points) of words that the field tags.

    A null or empty text scores like a text without toxic words, with no spans; equal texts score alike. Null ids and repeated rows are rows like any other; an
    empty table gives an empty table; other columns of docs are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = arrow_schema(f"{id_col} long, {OUT}")

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            value, p, starts, sizes = scorer(texts)
            spans, tagged = [], np.zeros(len(texts), dtype=np.int64)
            for i, text in enumerate(texts):
                on = np.flatnonzero(p[starts[i] : starts[i] + sizes[i]] >= 0.5)
                tagged[i] = len(on)
                spans.append(_spans(text, on) if len(on) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(value), pa.array((value >= 0.5).astype(np.int32)), pa.array(tagged), pa.array(spans, schema.field("spans").type)], schema=schema)

    return map_arrow(docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("_text")), stage, f"{id_col} long, {OUT}")


def kept(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """The rows of docs that score below one half, all columns as they were, whatever they are called.

    Null and empty texts score like texts without toxic words. Null ids and repeated rows are rows like any other; an empty table gives an
    empty table. Ids aren't read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            value, *_ = scorer([x or "" for x in batch.column(at).to_pylist()])
            yield batch.filter(pa.array(value < 0.5))

    return map_arrow(docs, stage, docs.schema)


def _spans(text: str, on: np.ndarray) -> list[dict[str, int]]:
    """Offsets of the tagged words, neighbours joined."""
    wanted, out, last = set(on.tolist()), [], -2
    for k, m in enumerate(_WORD.finditer(lowered(text))):
        if k in wanted:
            if last == k - 1:
                out[-1]["end"] = m.end()
            else:
                out.append({"start": m.start(), "end": m.end()})
            last = k
    return out
