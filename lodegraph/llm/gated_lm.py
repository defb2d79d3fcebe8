"""Log-likelihood of whole documents under a gated recurrent language model.

1. Words of all training rows are counted (each task hands on its own sums).  Counts
   are a table in the shared folder; only bounded parts of it leave the cluster: the
   TABLE_WORDS most frequent words at most, and sums for GROUPS groups of spellings.
2. The model predicts the SHORTLIST most frequent words, the group of any other word
   and the end of the text.  Its softmax is factored: first the class of the output,
   then the output within its class.  A word outside the shortlist has the probability
   of its group times its share (c + 1) / (count + words + 1) of the group's counts, so
   an unknown word has the same add-one share that it has in the base score.
3. Every text is turned into output ids once; training and scoring read these.
   Training is truncated backpropagation in numpy over windows of WINDOW tokens with
   the state carried from window to window; texts longer than PIECE tokens come to the
   trainer in pieces.  All training rows are dealt into packs of about TRAINER_TOKENS,
   whatever the input's size; each pack has its own trainer, and Spark averages their
   parameters after each pass over all packs (rounds, one by default).
4. Scoring runs lanes of documents side by side; a document's state is carried across
   windows from its first to its last token.  Words outside the table take their count
   from an equality join with the table of counts.

Defined results: null text counts as empty, whose only token is the end; a null doc_id
counts as empty text in the hash that holds rows out; repeated rows are scored and
counted each; without training rows the model is untrained; words above KEY_BYTES bytes
are told apart by SHA-256; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.common import crc_remainder, small_batches, stored, text_bytes

FOLDS, HELD_OUT = 7, 2
TABLE_WORDS = 1 << 18
SHORTLIST = 1024
GROUPS = 128
CLASSES = 32
EMBED, HIDDEN = 16, 16
WINDOW, TRAIN_LANES, SCORE_LANES, SCORE_WINDOW = 64, 128, 512, 48
TRAINER_TOKENS = 1_000_000
TASK_TRAINERS = 2
PIECE = 4096
ROUNDS = 1
RATE = 0.12
CLIP = 5.0
LIMIT = 60.0
SEED = 11
KEY_BYTES = 32
HELD_WORDS = 400_000
CHUNK_TOKENS = 4_000_000
FAN_IN = 64
BLOCK_FLOATS = 1 << 15
END = b""
EDGES = b".,;:!?\"'()[]{}*&%$#|-_"


def key_of(word: bytes) -> bytes:
    """A word, or the digest of a long one (no UTF-8 text holds the byte 255)."""
    return word if len(word) <= KEY_BYTES else b"\xff" + hashlib.sha256(word).digest()


def group_of(key: bytes) -> int:
    """The group of a key: by its last bytes, punctuation aside."""
    return zlib.crc32(key.strip(EDGES)[-2:]) % GROUPS


# ---------------------------------------------------------------- counts


def _counted(batches):
    def rows(held):
        keys = [key_of(w) for w in held]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(keys, pa.binary()),
                pa.array([group_of(k) for k in keys], pa.int32()),
                pa.array(list(held.values()), pa.int64()),
            ],
            names=["key", "group", "n"],
        )

    held: Counter = Counter()
    for batch in batches:
        for text in text_bytes(batch.column("text")):
            held.update(text.lower().split())
            held[END] += 1
            if len(held) > HELD_WORDS:
                yield rows(held)
                held = Counter()
    if held:
        yield rows(held)


def token_counts(docs: DataFrame) -> DataFrame:
    """key, group, n, bin of every token of docs (text); the end of texts has an empty key."""
    rows = docs.select("text").mapInArrow(_counted, "key binary, group int, n long")
    counts = rows.groupBy("key").agg(F.min("group").alias("group"), F.sum("n").alias("n"))
    return counts.withColumn("bin", F.floor(F.log2("n") * 64).cast("int"))


class Vocabulary:
    """What every task knows of the counts: frequent words, groups, totals."""

    def __init__(self, keys, counts, groups, group_counts, group_words, tokens, distinct, ends):
        order = sorted(range(len(keys)), key=lambda i: (-counts[i], keys[i]))
        keys, counts = [keys[i] for i in order], np.array([counts[i] for i in order], np.int64)
        groups = np.array([groups[i] for i in order], np.int64)
        self.tokens, self.distinct, self.ends = tokens, distinct, ends
        short = min(SHORTLIST, len(keys))
        rest_count = np.array(group_counts, float) - np.bincount(groups[:short], counts[:short], GROUPS)
        rest_words = np.array(group_words, float) - np.bincount(groups[:short], minlength=GROUPS)
        weight = np.r_[counts[:short], rest_count, ends] + 1.0
        rank = np.argsort(-weight, kind="stable")
        place = np.empty(len(rank), np.int32)
        place[rank] = np.arange(len(rank))
        self.weight = weight[rank]
        self.place = {k: i for i, k in enumerate(keys)}
        self.out_of = np.r_[place[:short], place[short : short + GROUPS][groups[short:]]].astype(np.int32)
        self.group_out, self.end_out = place[short : short + GROUPS], int(place[-1])
        self.group_size = np.log10(rest_count + rest_words + 1)
        self.base_log = np.log10(counts + 1.0)
        self.share_log = np.where(np.arange(len(keys)) < short, 0, self.base_log - self.group_size[groups])
        self.norm = float(np.log10(tokens + distinct + 1))

    def read(self, text: bytes):
        """Output ids with the end, n_known, log10 sums (base, model) and counts of the rest."""
        words, place = text.lower().split(), self.place
        at = np.fromiter(map(place.get, words, repeat(-1)), np.int32, len(words))
        rest: dict[bytes, int] = {}
        ids = np.empty(len(words) + 1, np.int32)
        ids[-1] = self.end_out
        share = 0.0
        for i in np.flatnonzero(at < 0).tolist():
            if len(words[i]) > KEY_BYTES:
                words[i] = key_of(words[i])
                at[i] = place.get(words[i], -1)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            unseen = [words[i] for i in missing.tolist()]
            rest = Counter(unseen)
            group = np.array([group_of(w) for w in unseen])
            ids[missing] = self.group_out[group]
            share -= float(self.group_size[group].sum())
        known = at >= 0
        hits = at[known]
        ids[:-1][known] = self.out_of[hits]
        base = float(self.base_log[hits].sum()) + np.log10(self.ends + 1) - len(ids) * self.norm
        share += float(self.share_log[hits].sum())
        return ids, len(hits) + int(self.ends > 0), base, share, rest


def vocabulary(counts: DataFrame) -> tuple[Vocabulary, int]:
    """The vocabulary of stored counts, and the bin from which words are in its table."""
    sums = counts.groupBy("group", (F.col("key") == F.lit(END)).alias("end")).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")
    )
    group_counts, group_words, ends, distinct = [0] * GROUPS, [0] * GROUPS, 0, 0
    for row in sums.collect():  # at most GROUPS + 1 rows
        distinct += row["words"]
        if row["end"]:
            ends = row["n"]
        else:
            group_counts[row["group"]], group_words[row["group"]] = row["n"], row["words"]
    sizes = counts.groupBy("bin").agg(F.count(F.lit(1)).alias("c")).collect()  # at most 64 x 64 rows
    cut, held = 1 << 20, 0
    for row in sorted(sizes, key=lambda r: -r["bin"]):
        if held + row["c"] > TABLE_WORDS:
            break
        cut, held = row["bin"], held + row["c"]
    table = counts.filter((F.col("bin") >= cut) & (F.col("key") != F.lit(END))).toArrow()
    keys, n, groups = (table.column(c).to_pylist() for c in ("key", "n", "group"))
    tokens = sum(group_counts) + ends
    return Vocabulary(keys, n, groups, group_counts, group_words, tokens, distinct, ends), cut


# ---------------------------------------------------------------- network


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _softmax_error(logits: np.ndarray, target: np.ndarray, scale: float) -> np.ndarray:
    """Gradient of scale times the negative log-softmax of each row's target, in place of the logits."""
    np.clip(logits, -LIMIT, LIMIT, out=logits)
    np.exp(logits, out=logits)
    logits *= scale / logits.sum(1, keepdims=True)
    logits[np.arange(len(target)), target] -= scale
    return logits


class Network:
    """A gated recurrent unit with a class-factored softmax; float32 parameters in one vector."""

    def __init__(self, weight: np.ndarray, vector: np.ndarray | None = None):
        n = len(weight)
        mass = np.cumsum(weight) / weight.sum()
        of = np.minimum(((mass - weight / weight.sum() / 2) * CLASSES).astype(np.int64), CLASSES - 1)
        _, self.class_of = np.unique(of, return_inverse=True)
        self.low = np.r_[np.flatnonzero(np.diff(self.class_of, prepend=-1)), n]
        self.n_classes, self.start = len(self.low) - 1, n
        shapes = {
            "embed": (n + 1, EMBED),
            "into": (EMBED, 3 * HIDDEN),
            "shift": (3 * HIDDEN,),
            "back": (HIDDEN, 3 * HIDDEN),
            "class_out": (HIDDEN, self.n_classes),
            "class_bias": (self.n_classes,),
            "word_out": (n, HIDDEN),
            "word_bias": (n,),
        }
        size = sum(int(np.prod(s)) for s in shapes.values())
        if vector is None:
            vector = np.zeros(2 * size, np.float32)
            vector[size:] = 0.05
        self.vector, at = vector, 0
        self.square = {}
        for name, shape in shapes.items():
            to = at + int(np.prod(shape))
            setattr(self, name, vector[at:to].reshape(shape))
            self.square[name] = vector[size + at : size + to].reshape(shape)
            at = to
        if not vector[:size].any():
            rng = np.random.default_rng(SEED)
            self.embed[:] = rng.normal(0, 0.3, self.embed.shape)
            self.into[:] = rng.normal(0, 0.3, self.into.shape)
            self.back[:] = rng.normal(0, 0.3 / HIDDEN**0.5, self.back.shape)
            self.shift[:HIDDEN] = 1.0
            sums = np.add.reduceat(weight, self.low[:-1])
            self.class_bias[:] = np.log(sums / sums.sum())
            self.word_bias[:] = np.log(weight / sums[self.class_of])

    def states(self, given: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States after each of the given inputs (steps x lanes); fresh lanes start from zero."""
        table = self.embed @ self.into + self.shift if keep is None and self._table is None else self._table
        self._table = table
        pushed = table[given] if keep is None else self.embed[given] @ self.into + self.shift
        out = np.empty((*given.shape, HIDDEN), np.float32)
        two = 2 * HIDDEN
        for t in range(len(given)):
            if fresh[t].any():
                h = h * ~fresh[t][:, None]
            back = h @ self.back
            gates = _sigmoid(pushed[t, :, :two] + back[:, :two])
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            new = np.tanh(pushed[t, :, two:] + r * back[:, two:])
            before, h = h, new + z * (h - new)
            out[t] = h
            if keep is not None:
                keep.append((before, z, r, new, back[:, two:]))
        return out

    _table = None

    def log_probabilities(self, h: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural logs of the probability of each target after the states h."""
        of = self.class_of[target]
        order = np.argsort(of, kind="stable")
        h, of, target = h[order], of[order], target[order]
        logits = np.clip(h @ self.class_out + self.class_bias, -LIMIT, LIMIT)
        logs = logits[np.arange(len(h)), of]
        logs -= np.log(np.exp(logits, out=logits).sum(1))
        edges = np.searchsorted(of, np.arange(self.n_classes + 1)).tolist()
        for c in range(self.n_classes):
            rows, part = slice(edges[c], edges[c + 1]), slice(self.low[c], self.low[c + 1])
            if rows.stop > rows.start and part.stop - part.start > 1:
                inner = np.clip(h[rows] @ self.word_out[part].T + self.word_bias[part], -LIMIT, LIMIT)
                logs[rows] += inner[np.arange(len(inner)), target[rows] - part.start]
                logs[rows] -= np.log(np.exp(inner, out=inner).sum(1))
        out = np.empty_like(logs)
        out[order] = logs
        return out

    def _adjust(self, name: str, where, gradient: np.ndarray) -> None:
        values, square = getattr(self, name), self.square[name]
        square[where] += gradient * gradient
        values[where] -= RATE * gradient / np.sqrt(square[where])

    def learn(self, given: np.ndarray, fresh: np.ndarray, target: np.ndarray, h: np.ndarray) -> np.ndarray:
        """One step of truncated backpropagation over a window; the state at its end."""
        keep: list = []
        out = self.states(given, fresh, h, keep)
        at_t, lane = np.nonzero(target >= 0)
        rows, wanted = out[at_t, lane], target[at_t, lane]
        if not len(rows):
            return out[-1]
        of, scale = self.class_of[wanted], 1 / TRAIN_LANES
        order = np.argsort(of.astype(np.uint16), kind="stable")
        at_t, lane, rows, wanted, of = at_t[order], lane[order], rows[order], wanted[order], of[order]
        p = _softmax_error(rows @ self.class_out + self.class_bias, of, scale)
        push = p @ self.class_out.T
        steps = [("class_out", ..., rows.T @ p), ("class_bias", ..., p.sum(0))]
        edges = np.searchsorted(of, np.arange(self.n_classes + 1)).tolist()
        for c in range(self.n_classes):
            mine, part = slice(edges[c], edges[c + 1]), slice(self.low[c], self.low[c + 1])
            if mine.stop > mine.start and part.stop - part.start > 1:
                words = self.word_out[part]
                q = _softmax_error(rows[mine] @ words.T + self.word_bias[part], wanted[mine] - part.start, scale)
                push[mine] += q @ words
                steps += [("word_out", part, q.T @ rows[mine]), ("word_bias", part, q.sum(0))]
        d_out = np.zeros_like(out)
        d_out[at_t, lane] = push
        d_pushed = np.zeros((*given.shape, 3 * HIDDEN), np.float32)
        d_back_all = np.zeros_like(d_pushed)
        dh = np.zeros_like(h)
        before, z, r, new, back = (np.stack(x) for x in zip(*keep))
        of_new = (1 - z) * (1 - new * new)
        of_both = np.concatenate([(before - new) * z * (1 - z), of_new * back * r * (1 - r), of_new * r], axis=2)
        of_both, turned = of_both.reshape(*given.shape, 3, HIDDEN), np.ascontiguousarray(self.back.T)
        d_back, live = d_back_all.reshape(of_both.shape), (~fresh)[:, :, None]
        stays = ~fresh.any(1)
        dhs = np.empty_like(out)
        for t in range(len(given) - 1, -1, -1):
            dh = np.add(dh, d_out[t], out=dhs[t])
            np.multiply(of_both[t], dh[:, None], out=d_back[t])
            dh = dh * z[t]
            dh += d_back_all[t] @ turned
            if not stays[t]:
                dh *= live[t]
        two = 2 * HIDDEN
        d_pushed[:, :, :two], d_pushed[:, :, two:] = d_back_all[:, :, :two], dhs * of_new
        firsts = before.reshape(-1, HIDDEN)
        flat = d_pushed.reshape(-1, 3 * HIDDEN)
        order = np.argsort(given.ravel().astype(np.uint16), kind="stable")
        inputs = given.ravel()[order]
        first = np.flatnonzero(np.diff(inputs, prepend=-1))
        seen, d_embed = inputs[first], np.add.reduceat((flat @ self.into.T)[order], first)
        steps += [
            ("back", ..., firsts.T @ d_back_all.reshape(-1, 3 * HIDDEN)),
            ("into", ..., self.embed[given.ravel()].T @ flat),
            ("shift", ..., flat.sum(0)),
            ("embed", seen, d_embed),
        ]
        norm = float(np.sqrt(sum(float((g * g).sum()) for _, _, g in steps)))
        shrink = np.float32(min(1.0, CLIP / max(norm, 1e-9)))
        for name, where, g in steps:
            self._adjust(name, where, g * shrink)
        return out[-1]


def lanes_of(lengths: list[int], most: int) -> list[list[int]]:
    """Documents dealt to lanes, longest first, each to the shortest lane."""
    n = max(1, min(most, sum(lengths) // max(lengths)))
    heap, lanes = [(0, i) for i in range(n)], [[] for _ in range(n)]
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        size, lane = heapq.heappop(heap)
        lanes[lane].append(i)
        heapq.heappush(heap, (size + lengths[i], lane))
    return sorted((x for x in lanes if x), key=lambda x: -sum(lengths[i] for i in x))


def woven(texts: list[np.ndarray], most: int, start: int):
    """Lanes of texts side by side: inputs, targets (-1: none), first tokens, text numbers, lane lengths."""
    lanes = lanes_of([len(t) for t in texts], most)
    sizes = [sum(len(texts[i]) for i in lane) for lane in lanes]
    shape = max(sizes), len(lanes)
    target, number = np.full(shape, -1, np.int32), np.zeros(shape, np.int32)
    given, fresh = np.full(shape, start, np.int32), np.zeros(shape, bool)
    for x, lane in enumerate(lanes):
        at = 0
        for i in lane:
            to = at + len(texts[i])
            target[at:to, x], number[at:to, x], fresh[at, x] = texts[i], i, True
            given[at + 1 : to, x] = texts[i][:-1]
            at = to
    return given, target, fresh, number, np.array(sizes)


def log_likelihoods(net: Network, texts: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each text (output ids), its state carried from window to window."""
    out = np.zeros(len(texts))
    given, target, fresh, number, sizes = woven(texts, SCORE_LANES, net.start)
    h = np.zeros((given.shape[1], HIDDEN), np.float32)
    for at in range(0, len(given), SCORE_WINDOW):
        n = int((sizes > at).sum())
        part = slice(at, at + SCORE_WINDOW), slice(0, n)
        states = net.states(given[part], fresh[part], h[:n])
        h = states[-1]
        live = target[part] >= 0
        logs = net.log_probabilities(states[live], target[part][live])
        out += np.bincount(number[part][live], logs.astype(np.float64), len(texts))
    return out / np.log(10)


# ---------------------------------------------------------------- training


ENCODED = "doc_id long, n_tokens long, known long, base double, share double, rest array<struct<key:binary,n:long>>, ids binary"


def _encoded(vocabulary):
    """Each text as output ids, with what the vocabulary knows of its score."""

    def run(batches):
        words = vocabulary.value
        for batch in batches:
            found = [words.read(t) for t in text_bytes(batch.column("text"))]
            flat = [x for r in found for x in r[4].items()]
            pairs = pa.StructArray.from_arrays(
                [pa.array([k for k, _ in flat], pa.binary()), pa.array([n for _, n in flat], pa.int64())],
                fields=[pa.field("key", pa.binary()), pa.field("n", pa.int64())],
            )
            ends = np.cumsum([0, *(len(r[4]) for r in found)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(r[0]) for r in found], pa.int64()),
                    pa.array([r[1] for r in found], pa.int64()),
                    pa.array([r[2] for r in found], pa.float64()),
                    pa.array([r[3] for r in found], pa.float64()),
                    pa.ListArray.from_arrays(pa.array(ends), pairs),
                    pa.array([r[0].astype("<u2").tobytes() for r in found], pa.binary()),
                ],
                names=["doc_id", "n_tokens", "known", "base", "share", "rest", "ids"],
            )

    return run


def _packed(batches):
    def pack(held):
        return pa.RecordBatch.from_arrays(
            [pa.array([[len(t) // 2 for t in held]], pa.list_(pa.int64())), pa.array([b"".join(held)], pa.binary())],
            names=["lengths", "ids"],
        )

    held, tokens = [], 0
    for batch in batches:
        for text in batch.column("ids").to_pylist():
            held.append(text)
            tokens += len(text) // 2
            if tokens >= TRAINER_TOKENS:
                yield pack(held)
                held, tokens = [], 0
    if held:
        yield pack(held)


def _trained(vocabulary, weights, turn: int):
    def learnt(words, lengths, ids):
        texts = np.split(np.frombuffer(ids, "<u2").astype(np.int32), np.cumsum(lengths)[:-1])
        rng = np.random.default_rng([SEED, turn])
        texts = [t[at : at + PIECE] for t in texts for at in range(0, len(t), PIECE)]
        texts = [texts[i] for i in rng.permutation(len(texts))]
        net = Network(words.weight, weights.value.copy())
        given, target, fresh, _, _ = woven(texts, TRAIN_LANES, net.start)
        h = np.zeros((given.shape[1], HIDDEN), np.float32)
        for at in range(0, len(given), WINDOW):
            part = slice(at, at + WINDOW)
            h = net.learn(given[part], fresh[part], target[part], h)
        return net.vector.astype(np.float64) * sum(lengths)

    def run(batches):
        words, total, tokens = vocabulary.value, 0, 0
        for batch in batches:
            for lengths, ids in zip(batch.column("lengths").to_pylist(), batch.column("ids").to_pylist()):
                total, tokens = total + learnt(words, lengths, ids), tokens + sum(lengths)
        if not tokens:
            return
        task = TaskContext.get().partitionId()
        for block, low in enumerate(range(0, len(total), BLOCK_FLOATS)):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([block], pa.int32()),
                    pa.array([task], pa.int64()),
                    pa.array([float(tokens)], pa.float64()),
                    pa.array([total[low : low + BLOCK_FLOATS].tobytes()], pa.binary()),
                ],
                names=["block", "trainer", "tokens", "total"],
            )

    return run


def _added(key, table):
    total = sum(np.frombuffer(v, np.float64) for v in table.column("total").to_pylist())
    return pa.table(
        [
            table.column("block").slice(0, 1).combine_chunks(),
            table.column("trainer").slice(0, 1).combine_chunks(),
            pa.array([float(sum(table.column("tokens").to_pylist()))], pa.float64()),
            pa.array([total.tobytes()], pa.binary()),
        ],
        names=["block", "trainer", "tokens", "total"],
    )


PARTS = "block int, trainer long, tokens double, total binary"


def averaged(parts: DataFrame, trainers: int) -> np.ndarray | None:
    """Token-weighted mean of the vectors of each task's trainers; FAN_IN tasks meet in one group at most, about."""
    while trainers > 1:
        trainers = -(-trainers // FAN_IN)
        salt = F.pmod(F.xxhash64("trainer"), F.lit(trainers))
        parts = parts.withColumn("salt", salt).groupBy("block", "salt").applyInArrow(_added, PARTS)
    table = parts.toArrow().sort_by("block")
    if not table.num_rows:
        return None
    totals, tokens = table.column("total").to_pylist(), table.column("tokens").to_pylist()
    return np.concatenate([np.frombuffer(v, np.float64) / n for v, n in zip(totals, tokens)]).astype(np.float32)


def train(encoded: DataFrame, words: Vocabulary, sent, rounds: int = ROUNDS) -> np.ndarray:
    """Parameters learnt from all rows of encoded (row, ids); sent: broadcast words."""
    spark = encoded.sparkSession
    tasks = max(1, round(words.tokens / (TRAINER_TOKENS * TASK_TRAINERS)))
    dealt = encoded.select("row", "ids").repartition(tasks, F.xxhash64("row")).sortWithinPartitions(F.xxhash64("row"))
    packs = stored(dealt.mapInArrow(_packed, "lengths array<long>, ids binary"), "packs")
    vector = Network(words.weight).vector
    for turn in range(rounds):
        start = spark.sparkContext.broadcast(vector)
        parts = stored(packs.mapInArrow(_trained(sent, start, turn), PARTS), "round")
        found = averaged(parts, tasks)
        vector = vector if found is None else found
    return vector


# ---------------------------------------------------------------- scoring


SCORED = "row long, doc_id long, n_tokens long, known long, base double, share double"


def _scored(weight, weights):
    def flush(net, held, tables):
        logs = log_likelihoods(net, held)
        table = pa.Table.from_batches(tables)
        values = pa.array(np.asarray(table.column("share")) + logs)
        yield from table.set_column(table.schema.get_field_index("share"), "share", values).to_batches()

    def run(batches):
        net, held, tables, tokens = Network(weight, weights.value), [], [], 0
        for batch in batches:
            tables.append(batch.drop_columns(["ids"]))
            held += [np.frombuffer(ids, "<u2").astype(np.int32) for ids in batch.column("ids").to_pylist()]
            tokens += sum(len(t) for t in held[-batch.num_rows :]) if batch.num_rows else 0
            if tokens >= CHUNK_TOKENS:
                yield from flush(net, held, tables)
                held, tables, tokens = [], [], 0
        if held:
            yield from flush(net, held, tables)

    return run


def score(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held_out = crc_remainder(F.col("doc_id"), FOLDS) == HELD_OUT
    counts = stored(token_counts(rows.filter(~held_out)), "counts")
    words, cut = vocabulary(counts)
    sent = spark.sparkContext.broadcast(words)
    encoded = stored(
        rows.mapInArrow(_encoded(sent), ENCODED).withColumn("row", F.monotonically_increasing_id()), "encoded"
    )
    weights = spark.sparkContext.broadcast(train(encoded.filter(~held_out), words, sent, rounds))
    columns = [c.split()[0] for c in SCORED.split(", ")]
    scored = encoded.select(*columns, "ids").mapInArrow(_scored(words.weight, weights), SCORED)
    rest = encoded.select("row", F.explode("rest").alias("r")).select("row", "r.key", F.col("r.n").alias("times"))
    known = counts.filter(F.col("bin") < cut).select("key", "n")
    found = (
        rest.join(known, "key")
        .groupBy("row")
        .agg(
            F.sum("times").alias("more"),
            F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("log"),
        )
    )
    more, log = F.coalesce("more", F.lit(0)), F.coalesce("log", F.lit(0.0))
    return scored.join(found, "row", "left").select(
        "doc_id",
        held_out.alias("held_out"),
        "n_tokens",
        (F.col("known") + more).cast("long").alias("n_known"),
        F.lit(words.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + log).alias("base_score"),
        (F.col("share") + log).alias("score"),
    )
