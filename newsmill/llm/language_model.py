"""A gated recurrent language model with a class-factored softmax, in numpy.

Symbols are the end of a text, the most frequent words and groups of all other
words; both numbers grow with the root of the vocabulary. A symbol's class is
predicted from the state, then the symbol within its class; a word of a group
has a fixed share of it. Weights are learnt by truncated backpropagation, with
the state carried from window to window until a text ends."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsmill.llm._common import chunks, groups, new_path, scratch, staged, table, text_column, tune
from newsmill.llm._words import LOWER, Finder, hashes, spans
from newsmill.llm.language import remainder

HIDDEN = 16
#: Least number of words that are modelled one by one, if there are as many.
WORDS = 2046
#: A class of symbols is closed where its share of the tokens times its number of
#: symbols would pass this: frequent words are in small classes.
SHARE = 4.0
#: At most this many most frequent tokens are known to every task.
FREQUENT = 262_144
WINDOW = 16
#: Most and least streams of texts that a task learns from or scores side by side,
#: and the tokens that a stream holds of one buffer, if there are so many.
STREAMS, FEW, LANE = 512, 16, 8192
#: Tokens that a task lays out at once.
BUFFER = 1 << 22
RATE = 0.2
#: Rounds of local training and averaging. A hash of doc_id deals the training
#: documents to the rounds, so each is learnt from once.
ROUNDS = 2
SMOOTHING = 0.1
END_HASH = np.uint64(0x656E64656E64656E)
END = 0
BLOCK = 1 << 15
#: Logits are bounded by this, so that no exponential overflows.
CAP = np.float32(60)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of each token; every text ends in an end token."""
    low = LOWER[data]
    starts, ends, own = spans(low, offsets)
    word = hashes(low, starts, ends)
    n = len(offsets) - 1
    last = np.cumsum(np.bincount(own, minlength=n))
    at = last + np.arange(n)
    out = np.empty(len(word) + n, np.uint64)
    text = np.empty(len(out), np.int64)
    ending = np.zeros(len(out), bool)
    ending[at] = True
    out[at], text[at] = END_HASH, np.arange(n)
    out[~ending], text[~ending] = word, own
    return out, text


def token_counts(docs: DataFrame) -> DataFrame:
    """``h, c``: how often each token occurs in all of ``docs``. Tasks add up
    before the shuffle, in bounded memory."""

    def count(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged():
            key = np.concatenate([k for k, _ in held])
            many = np.concatenate([c for _, c in held])
            keys, back = np.unique(key, return_inverse=True)
            return keys, np.bincount(back, weights=many).astype(np.int64)

        def batch(keys, many):
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(many)], ["h", "c"])

        for _, data, offsets in chunks(batches, "text"):
            keys, many = np.unique(tokens(data, offsets)[0], return_counts=True)
            held.append((keys, many))
            size += len(keys)
            if size > 1_500_000:
                held = [merged()]
                size = len(held[0][0])
                if size > 1_000_000:
                    yield batch(*held[0])
                    held, size = [], 0
        if held:
            yield batch(*merged())

    return docs.select(text_column(docs).alias("text")).mapInArrow(count, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))


def most_frequent(counts: DataFrame, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the tokens above the least count that leaves ``most``
    of them at most, by falling count, then hash. The bound is read off a histogram
    of counts in steps of about a hundredth, so no task or driver holds more."""
    step = F.floor(F.log2("c") * 64).cast("int")
    histogram = sorted(((r.s, r.n) for r in counts.groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, total = None, 0
    for s, n in histogram:
        total += n
        if total > most:
            break
        least = s
    rows = counts.where(step >= least).collect() if least is not None else []
    rows.sort(key=lambda r: (-r.c, r.h))
    return np.array([r.h for r in rows], np.int64).view(np.uint64), np.array([r.c for r in rows], np.int64)


def groups_for(words: int) -> int:
    """Groups for so many words that aren't modelled one by one."""
    return max(1, math.isqrt(max(0, words - 1)) + 1)


def classes_for(weight: np.ndarray, share: float = SHARE) -> np.ndarray:
    """The class of each weight, the weights falling."""
    out = np.empty(len(weight), np.int64)
    k, mass, many = 0, 0.0, 0
    for i, w in enumerate((weight / weight.sum()).tolist()):
        if many and (mass + w) * (many + 1) > share:
            k, mass, many = k + 1, 0.0, 0
        out[i], mass, many = k, mass + w, many + 1
    return out


class Model:
    """Parameters in one float32 vector, so that they can be averaged. Output
    weights have a last column that is the bias."""

    def __init__(self, weight: np.ndarray, hidden: int = HIDDEN, share: float = SHARE, seed: int = 11):
        """weight: the smoothed occurrences of each symbol; symbol END is the end."""
        self.n, self.hidden = len(weight), hidden
        order = np.argsort(-weight, kind="stable")
        cls = classes_for(weight[order], share)
        self.classes = int(cls[-1]) + 1
        self.first = np.searchsorted(cls, np.arange(self.classes + 1))
        self.cls = np.empty(self.n, np.int16 if self.classes < 2**15 else np.int32)
        self.cls[order] = cls
        self.place = np.empty(self.n, np.int64)
        self.place[order] = np.arange(self.n)
        self.shapes = {"Wx": (self.n, 3 * hidden), "U": (hidden, 3 * hidden), "b": (3 * hidden,), "Wc": (self.classes, hidden + 1), "Ww": (self.n, hidden + 1)}
        self.vector = np.zeros(sum(int(np.prod(s)) for s in self.shapes.values()), np.float32)
        p = self.parts()
        rng = np.random.default_rng(seed)
        p["Wx"][:] = rng.normal(0, 0.3, self.shapes["Wx"])
        p["U"][:] = rng.normal(0, hidden**-0.5, self.shapes["U"])
        mass = np.bincount(cls, weights=weight[order])
        p["Wc"][:, -1] = np.log(mass / mass.sum())
        p["Ww"][:, -1] = np.log(weight[order] / mass[cls])

    def parts(self, vector: np.ndarray | None = None) -> dict[str, np.ndarray]:
        vector = self.vector if vector is None else vector
        out, at = {}, 0
        for k, s in self.shapes.items():
            size = int(np.prod(s))
            out[k] = vector[at : at + size].reshape(s)
            at += size
        return out


def window_states(p: dict, x: np.ndarray, fresh: np.ndarray, h: np.ndarray) -> dict:
    """Gates and states of a window: x, fresh: steps by streams."""
    steps, lanes = x.shape
    size = h.shape[1]
    a = np.take(p["Wx"], x.ravel(), axis=0)
    a += p["b"]
    a = a.reshape(steps, lanes, 3 * size)
    a[:, :, : 2 * size] *= np.float32(0.5)
    gates_u = p["U"][:, : 2 * size] * np.float32(0.5)
    new_u = np.ascontiguousarray(p["U"][:, 2 * size :])
    out = {"before": np.empty((steps, lanes, size), np.float32), "zr": np.empty((steps, lanes, 2 * size), np.float32), "n": np.empty((steps, lanes, size), np.float32), "q": np.empty((steps, lanes, size), np.float32), "h": np.empty((steps, lanes, size), np.float32)}
    some = fresh.any(axis=1)
    for t in range(steps):
        before = out["before"][t]
        before[:] = h
        if some[t]:
            before[fresh[t]] = 0
        g = np.matmul(before, gates_u, out=out["zr"][t])
        g += a[t, :, : 2 * size]
        np.tanh(g, out=g)  # the sigmoid of 2x is (1 + tanh x) / 2
        g *= np.float32(0.5)
        g += np.float32(0.5)
        q = np.matmul(before, new_u, out=out["q"][t])
        n = np.multiply(g[:, size:], q, out=out["n"][t])
        n += a[t, :, 2 * size :]
        np.tanh(n, out=n)
        h = np.subtract(before, n, out=out["h"][t])
        h *= g[:, :size]
        h += n
    return out


def targets(model: Model, p: dict, h: np.ndarray, y: np.ndarray, grad: dict | None = None):
    """Natural log-probability of each target; with ``grad``, its gradients (of the
    sum of -log p) are added there, and that of h is returned as well."""
    cls = model.cls[y]
    order = np.argsort(cls, kind="stable")
    cls = cls[order]
    state = np.empty((h.shape[1] + 1, len(y)), np.float32)
    state[:-1], state[-1] = np.take(h, order, axis=0).T, 1
    place, column = model.place[y[order]], np.arange(len(y))
    ones = np.ones(max(model.n, model.classes), np.float32)
    # no state is over 1, so no logit is over the sum of its weights
    over = max(float(np.abs(p[k]).sum(axis=1).max(initial=0)) for k in ("Wc", "Ww")) > 0.999 * float(CAP)

    def softmax(weights, own, row):
        x = weights @ own
        if over:
            np.minimum(x, CAP, out=x)
        picked = x[row, column[: len(row)]]
        np.exp(x, out=x)
        total = ones[: len(x)] @ x
        if grad is not None:
            x /= total
            x[row, column[: len(row)]] -= 1
        return picked - np.log(total), x

    out, x = softmax(p["Wc"], state, cls)
    if grad is not None:
        grad["Wc"] += x @ state.T
        back = p["Wc"].T @ x
    cuts = np.searchsorted(cls, np.arange(model.classes + 1))
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        a, b = cuts[k], cuts[k + 1]
        first, last = model.first[k], model.first[k + 1]
        own = state[:, a:b]
        value, x = softmax(p["Ww"][first:last], own, place[a:b] - first)
        out[a:b] += value
        if grad is not None:
            grad["Ww"][first:last] += x @ own.T
            back[:, a:b] += p["Ww"][first:last].T @ x
    value = np.empty(len(y))
    value[order] = out
    if grad is None:
        return value
    dh = np.empty((len(y), h.shape[1]), np.float32)
    dh[order] = back[:-1].T
    return value, dh


def gradients(model: Model, p: dict, x: np.ndarray, y: np.ndarray, fresh: np.ndarray, h: np.ndarray, grad: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Adds the gradients of a window's sum of -log p to ``grad`` (all but Wx);
    the states after it, the input symbols that occur and their rows of Wx's
    gradient. Targets of -1 are none."""
    steps, lanes = x.shape
    size = model.hidden
    s = window_states(p, x, fresh, h)
    flat = y.ravel()
    states = s["h"].reshape(-1, size)
    live = np.flatnonzero(flat >= 0)
    if len(live) == len(flat):
        dh = targets(model, p, states, flat, grad)[1]
    else:
        dh = np.zeros_like(states)
        dh[live] = targets(model, p, states[live], flat[live], grad)[1]
    dh = dh.reshape(steps, lanes, size)
    gate = np.empty((steps, lanes, 3 * size), np.float32)
    new = np.empty((steps, lanes, size), np.float32)
    carry = np.zeros((lanes, size), np.float32)
    back = np.ascontiguousarray(p["U"].T)
    some = fresh.any(axis=1)
    # the factors that don't hang on later steps, for all steps at once
    z, r = np.ascontiguousarray(s["zr"][:, :, :size]), np.ascontiguousarray(s["zr"][:, :, size:])
    n, rest = s["n"], 1 - z
    by_z = s["before"] - n
    by_z *= z
    by_z *= rest
    by_n = n * n
    np.subtract(1, by_n, out=by_n)
    by_n *= rest
    by_r = np.subtract(1, r, out=rest)
    by_r *= r
    by_r *= s["q"]
    for t in range(steps - 1, -1, -1):
        d = dh[t]
        d += carry
        dn = np.multiply(d, by_n[t], out=new[t])
        np.multiply(d, by_z[t], out=gate[t, :, :size])
        np.multiply(dn, by_r[t], out=gate[t, :, size : 2 * size])
        np.multiply(dn, r[t], out=gate[t, :, 2 * size :])
        carry = gate[t] @ back
        d *= z[t]
        carry += d
        if some[t]:
            carry[fresh[t]] = 0
    gate = gate.reshape(-1, 3 * size)
    grad["U"] += s["before"].reshape(-1, size).T @ gate
    gate[:, 2 * size :] = new.reshape(-1, size)
    grad["b"] += gate.sum(axis=0)
    symbol = x.ravel()
    order = np.argsort(symbol, kind="stable")
    symbol = symbol[order]
    first = np.flatnonzero(np.append(True, symbol[1:] != symbol[:-1]))
    return s["h"][-1], symbol[first], np.add.reduceat(gate[order], first, axis=0)


def streams(sizes: np.ndarray, n: int) -> list[list[int]]:
    """Texts dealt to at most n streams, longest first to the shortest stream;
    the streams come longest first."""
    heap = [(0, k) for k in range(min(n, len(sizes)))]
    out: list[list[int]] = [[] for _ in heap]
    for i in np.argsort(-sizes, kind="stable").tolist():
        have, k = heapq.heappop(heap)
        out[k].append(i)
        heapq.heappush(heap, (have + int(sizes[i]), k))
    return sorted(out, key=lambda s: -sum(int(sizes[i]) for i in s))


def lanes_for(sizes: np.ndarray) -> int:
    """Streams for texts of these sizes: many, but each about as long as the
    longest text, so that few steps are taken with few streams."""
    long = max(LANE, min(int(sizes.max(initial=0)), 4 * LANE))
    return int(min(STREAMS, max(FEW, sizes.sum() // long)))


def windows(texts: list[np.ndarray], n: int, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Targets, inputs, starts of texts and texts (steps by streams) of the texts,
    each whole in one stream. Streams that have ended are left out; a target of -1
    is past the end of one that ends inside the window."""
    sizes = np.array([len(t) for t in texts], np.int64)
    lanes = streams(sizes, n)
    length = np.array([int(sizes[lane].sum()) for lane in lanes], np.int64)
    steps = int(length.max(initial=0))
    y = np.full((steps, len(lanes)), -1, np.int32)
    fresh = np.zeros((steps, len(lanes)), bool)
    own = np.zeros((steps, len(lanes)), np.int32)
    for k, lane in enumerate(lanes):
        y[: length[k], k] = np.concatenate([texts[i] for i in lane])
        own[: length[k], k] = np.repeat(np.array(lane, np.int32), sizes[lane])
        fresh[np.cumsum(sizes[lane]) - sizes[lane], k] = True
    x = np.zeros_like(y)
    np.maximum(y[:-1], END, out=x[1:])
    x[fresh] = END
    for a in range(0, steps, width):
        live = int(np.searchsorted(-length, -a, "left"))
        yield y[a : a + width, :live], x[a : a + width, :live], fresh[a : a + width, :live], own[a : a + width, :live]


def train(model: Model, texts: list[np.ndarray], seen: np.ndarray, window: int = WINDOW, n: int | None = None, rate: float = RATE) -> None:
    """One pass of truncated backpropagation over the texts (each ends in END), by
    Adagrad; ``seen`` holds its sums of squares and is added to."""
    n = min(len(texts), n or lanes_for(np.array([len(t) for t in texts])))
    p, squares = model.parts(), model.parts(seen)
    made = np.zeros_like(model.vector)
    grad = model.parts(made)
    rest = slice(int(np.prod(model.shapes["Wx"])), None)
    scale = np.float32(1 / (n * window))  # a window of few streams is a small step
    h = np.zeros((n, model.hidden), np.float32)
    for y, x, fresh, _ in windows(texts, n, window):
        made[rest] = 0
        h, rows, g = gradients(model, p, x, y, fresh, h[: y.shape[1]], grad)
        g *= scale
        total = squares["Wx"][rows]
        total += g * g
        squares["Wx"][rows] = total
        p["Wx"][rows] -= rate * g / np.sqrt(total)
        own = made[rest]
        own *= scale
        seen[rest] += own * own
        own *= rate
        own /= np.sqrt(seen[rest])
        model.vector[rest] -= own


def score_texts(model: Model, texts: list[np.ndarray], window: int = 2 * WINDOW, n: int | None = None) -> np.ndarray:
    """Natural log-probability of each whole text's symbols, the end included."""
    n = min(len(texts), n or lanes_for(np.array([len(t) for t in texts])))
    p = model.parts()
    out = np.zeros(len(texts))
    h = np.zeros((n, model.hidden), np.float32)
    for y, x, fresh, own in windows(texts, n, window):
        states = window_states(p, x, fresh, h[: y.shape[1]])["h"]
        h = states[-1]
        flat = y.ravel()
        live = flat >= 0
        value = targets(model, p, states.reshape(-1, model.hidden)[live], flat[live])
        out += np.bincount(own.ravel()[live], weights=value, minlength=len(texts))
    return out


def _buffers(batches: Iterator[pa.RecordBatch], limit: int = BUFFER) -> Iterator[tuple[list[pa.RecordBatch], list[np.ndarray]]]:
    """Batches with about ``limit`` symbols together (rows are never parted), and
    the symbols of each row."""
    held, texts, size = [], [], 0
    for batch in batches:
        column = batch.column(batch.schema.get_field_index("symbols"))
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            own = [np.frombuffer(x.as_buffer(), np.int32) for x in column.slice(at, 256)]
            held.append(part)
            texts += own
            size += sum(map(len, own))
            if size >= limit:
                yield held, texts
                held, texts, size = [], [], 0
    if held:
        yield held, texts


#: Sum of squares that a parameter starts from: about a first gradient's square.
START = 1e-6


def average_round(numbered: DataFrame, model: Model) -> np.ndarray:
    """Each task trains its own copy on its texts; the mean of the copies, by
    tokens. Parameter blocks are summed in executors: only the mean, whose size
    grows with the root of the vocabulary, reaches the driver."""
    sent = numbered.sparkSession.sparkContext.broadcast(model)

    def fit(batches):
        import copy

        own, seen, squares = None, 0, None
        for _, texts in _buffers(batches):
            if own is None:
                own = copy.deepcopy(sent.value)
                squares = np.full_like(own.vector, START)
            train(own, texts, squares)
            seen += sum(map(len, texts))
        if seen:
            blocks = [own.vector[a : a + BLOCK].astype(np.float64) * seen for a in range(0, len(own.vector), BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array([seen] * len(blocks), pa.int64()), pa.array([b.astype(np.float32).tobytes() for b in blocks], pa.binary())], ["block", "n", "w"])

    def add(batches):
        for (block,), rows in groups(batches, ["block"]):
            many = sum(rows.column("n").to_pylist())
            w = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in rows.column("w").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([many], pa.int64()), pa.array([(w / many).astype(np.float32).tobytes()], pa.binary())], ["block", "n", "w"])

    schema = "block int, n bigint, w binary"
    made = numbered.select("symbols").mapInArrow(fit, schema).repartition("block").sortWithinPartitions("block").mapInArrow(add, schema)
    out = model.vector.copy()
    for r in made.collect():
        w = np.frombuffer(r.w, np.float32)
        out[r.block * BLOCK : r.block * BLOCK + len(w)] = w
    return out


def round_of(doc_id):
    """The round that a training document is learnt from in."""
    return F.pmod(F.xxhash64(doc_id.cast("string")), F.lit(ROUNDS)).cast("int")


def score_documents(docs: DataFrame, mod: int = 10) -> DataFrame:
    """Base and model score of each document; see the module and op4.

    Token counts are over all training documents (known remainder other than 0),
    and weights are learnt from every one of them, once. Symbols are the end, the
    max(WORDS, sqrt V) most frequent words and sqrt V groups (by hash) of the
    other words. A group's probability is times the word's share of the counts in
    its group, smoothed like the base score, so the probabilities of all tokens
    (the unseen ones of each group as one) sum to 1.

    Texts are tokenized once to count and once to number; symbols are written to
    the shared folder for the rounds and the scores. Null ids: not held out, not
    learnt from. Null texts have the end token alone. Repeated rows keep a row
    each. Without training documents all tokens are unknown. An empty table gives
    no rows; other columns don't matter."""
    path = new_path(docs.sparkSession, "scores")
    with scratch(docs.sparkSession):
        return staged(_scores(docs, mod), "scores", path)


def _scores(docs: DataFrame, mod: int) -> DataFrame:
    spark = docs.sparkSession
    tune(spark)
    training = docs.where(remainder(mod) != 0)
    counts = staged(token_counts(training), "counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    words, many = most_frequent(counts)
    modelled = np.flatnonzero(words != END_HASH)[: max(WORDS, math.isqrt(v))]
    ending = int(many[words == END_HASH].sum())
    single = np.append(modelled, np.flatnonzero(words == END_HASH))
    groups_ = groups_for(v - len(single))
    mass = np.full(groups_, SMOOTHING)
    for r in counts.groupBy(F.pmod("h", F.lit(groups_)).alias("g")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():
        mass[r.g] += r.c + SMOOTHING * r.n
    np.subtract.at(mass, words[single].view(np.int64) % groups_, many[single] + SMOOTHING)
    mass = np.maximum(mass, SMOOTHING)
    model = Model(np.concatenate([[ending + SMOOTHING], many[modelled] + SMOOTHING, mass]))
    base_mass = n + SMOOTHING * (v + 1)
    # of each frequent token: its symbol, what it adds to the base and, in a group, its share
    symbol = 1 + len(modelled) + words.view(np.int64) % groups_
    share = np.log10(many + SMOOTHING) - np.log10(mass[words.view(np.int64) % groups_])
    symbol[modelled], share[modelled] = 1 + np.arange(len(modelled)), 0.0
    symbol[words == END_HASH], share[words == END_HASH] = END, 0.0
    sent = spark.sparkContext.broadcast((Finder(words), symbol.astype(np.int32), share, np.log10((many + SMOOTHING) / base_mass), np.log10(mass)))
    round_ = F.when(remainder(mod) != 0, round_of(F.col("doc_id")))
    rows = docs.select("doc_id", F.coalesce(remainder(mod) == 0, F.lit(False)).alias("held_out"), round_.alias("round"), text_column(docs).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    first_group = 1 + len(modelled)

    def number(batches):
        finder, symbol, share, base_of, log_mass = sent.value
        rid = TaskContext.get().partitionId() << 40
        for part, data, offsets in chunks(batches, "text"):
            texts = part.num_rows
            h, text = tokens(data, offsets)
            at = np.searchsorted(text, np.arange(texts + 1))
            place = finder.find(h)
            far = np.flatnonzero((place < 0) & (h != END_HASH))
            group = h[far].view(np.int64) % len(log_mass)
            if len(symbol):
                y = symbol[place]
                more, base = share[place], base_of[place]
            else:
                y, more, base = np.zeros(len(h), np.int32), np.zeros(len(h)), np.zeros(len(h))
            y[far] = first_group + group
            more[far], base[far] = -log_mass[group], 0.0
            lost = (place < 0) & (h == END_HASH)
            y[lost], more[lost], base[lost] = END, 0.0, 0.0
            known = np.bincount(text[place >= 0], minlength=texts)
            total = [np.bincount(text, weights=w, minlength=texts) for w in (base, more)]
            unknown = np.flatnonzero(place < 0)
            keys, back = np.unique(h[unknown], return_inverse=True)
            pair, tf = np.unique(text[unknown] * max(1, len(keys)) + back, return_counts=True)
            cuts = np.searchsorted(pair, np.arange(texts + 1) * max(1, len(keys)))
            ids = pa.array(range(rid, rid + texts), pa.int64())
            rid += texts
            lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x)) for x in (keys[pair % max(1, len(keys))].view(np.int64), tf.astype(np.int32))]
            raw = y.astype(np.int32).tobytes()
            symbols = pa.array([raw[4 * a : 4 * b] for a, b in zip(at[:-1], at[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([ids, *part.columns[:3], pa.array(np.diff(at)), pa.array(known), pa.array(total[0]), pa.array(total[1]), *lists, symbols], ["rid", "doc_id", "held_out", "round", "n_tokens", "known", "base", "more", "h", "tf", "symbols"])

    numbered = staged(rows.mapInArrow(number, f"rid bigint, doc_id {kind}, held_out boolean, round int, n_tokens bigint, known bigint, base double, more double, h array<bigint>, tf array<int>, symbols binary"), "numbered")
    for k in range(ROUNDS):
        model.vector = average_round(numbered.where(F.col("round") == k), model)
    learnt = spark.sparkContext.broadcast(model)
    names = ["rid", "doc_id", "held_out", "n_tokens", "known", "base", "total"]

    def score(batches):
        for held, texts in _buffers(batches):
            value = score_texts(learnt.value, texts) / math.log(10)
            rows_ = pa.Table.from_batches(held).drop_columns(["symbols"]).combine_chunks()
            total = pa.array(rows_.column("more").to_numpy() + value)
            for batch in rows_.drop_columns(["more"]).append_column("total", total).select(names).to_batches(1000):
                yield batch

    first = numbered.select("rid", "doc_id", "held_out", "n_tokens", "known", "base", "more", "symbols").mapInArrow(score, f"rid bigint, doc_id {kind}, held_out boolean, n_tokens bigint, known bigint, base double, total double")
    rare = numbered.select("rid", F.explode(F.arrays_zip("h", "tf")).alias("x")).select("rid", "x.h", "x.tf")
    c = F.coalesce(F.col("c"), F.lit(0))
    part = F.col("tf") * F.log10((c + SMOOTHING) / F.lit(float(base_mass)))
    own = F.when(F.col("h") == int(END_HASH), 0.0).otherwise(F.col("tf") * F.log10(c + SMOOTHING))  # the group's mass is taken off before
    rare = rare.join(counts, "h", "left").groupBy("rid").agg(F.sum(F.when(c > 0, F.col("tf")).otherwise(0)).alias("known2"), F.sum(part).alias("base2"), F.sum(own).alias("total2"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    joined = first.join(rare, "rid", "left")
    return joined.select("doc_id", "held_out", "n_tokens", (F.col("known") + zero("known2")).alias("n_known"), F.lit(n).cast("bigint").alias("train_tokens"), (F.col("base") + zero("base2")).alias("base_score"), (F.col("total") + zero("total2")).alias("score"))


def op4_gated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document with its base score and the model's; nulls, empty
    and repeated rows as ``score_documents`` says."""
    return score_documents(table(spark, sf_dir, "documents"))
