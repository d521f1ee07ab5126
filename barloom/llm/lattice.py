"""Language-model scores from a lattice of subword pieces.

The vocabulary is an existing piece model.  Its scores give the first weights; one
expectation step over all training words re-weights the pieces.  The probability of a
word is the sum over all its segmentations, by a forward recursion in log space, and a
text's is the product over its words and one end mark.

A word-level base model is scored beside it.  Its counts cover the whole corpus and
never meet in one place: words are hashed into buckets, each bucket is merged and looked
up by one task, and only a constant number of the most frequent words is broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import scratch
from barloom.llm.kernels import LOWER, column, span_hash, spans_of_words, text_slices

#: Frequent words that every task knows; 2 MB whatever the input.
FREQUENT = 1 << 17
#: Weight of the vocabulary's own scores against the counts of the expectation step.
PRIOR = 10_000.0
MARK = "▁".encode()
_SCALAR = 120


class Pieces:
    """A piece vocabulary as a byte trie with a log weight for every piece."""

    def __init__(self, names: list[bytes], weights: np.ndarray):
        self.names, self.log_weight = names, weights
        children: list[dict[int, int]] = [{}]
        piece = [-1]
        for i, name in enumerate(names):
            at = 0
            for b in name:
                nxt = children[at].get(b)
                if nxt is None:
                    nxt = children[at][b] = len(children)
                    children.append({})
                    piece.append(-1)
                at = nxt
            piece[at] = i
        # Node 0 is the root and the last row a dead end that leads to itself.
        self.dead = len(children)
        self.next = np.full((len(children) + 1, 256), self.dead, np.int32)
        for node, kids in enumerate(children):
            if kids:
                self.next[node, list(kids)] = list(kids.values())
        self.piece = np.array([*piece, -1], np.int32)
        self.longest = max(map(len, names))

    @staticmethod
    def read(path: str) -> tuple[list[bytes], np.ndarray]:
        """Names and starting log weights of a piece model.

        The file's scores are the negated ranks of its pieces, so the weights follow
        Zipf's law: proportional to 1 / (rank + 2.7).  Byte pieces stand for one byte
        and take the weight of the last rank.
        """
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names, scores = [], []
        for i in range(model.get_piece_size()):
            if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                continue
            name = model.id_to_piece(i)
            names.append(bytes([int(name[3:5], 16)]) if model.is_byte(i) else name.encode())
            scores.append(math.inf if model.is_byte(i) else -model.get_score(i))
        rank = np.array(scores)
        rank[np.isinf(rank)] = rank[np.isfinite(rank)].max()
        raw = dict()
        for name, w in zip(names, 1 / (rank + 2.7), strict=True):
            raw[name] = raw.get(name, 0.0) + w
        w = np.array(list(raw.values()))
        return list(raw), np.log(w / w.sum())

    def forward(self, words: list[bytes], counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log probability of each word; with ``counts``, also expected piece counts."""
        out = np.empty(len(words))
        expected = None if counts is None else np.zeros(len(self.names))
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(size, kind="stable")
        edges = np.flatnonzero(np.diff(size[order], prepend=-1, append=-1))
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            for at in range(lo, hi, 20_000):
                pick = order[at : min(at + 20_000, hi)]
                n = int(size[pick[0]])
                if n == 0:
                    out[pick] = 0.0
                    continue
                text = np.frombuffer(b"".join([words[i] for i in pick]), np.uint8).reshape(len(pick), n)
                out[pick] = self._group(np.ascontiguousarray(text.T), None if counts is None else counts[pick], expected)
        return out, expected

    def _group(self, text: np.ndarray, counts: np.ndarray | None, expected: np.ndarray | None) -> np.ndarray:
        """Words of one length, one column each."""
        n, m = text.shape
        alpha = np.full((n + 1, m), -np.inf)
        alpha[0] = 0
        arcs = []
        for i in range(n):
            live, state, start = None, np.zeros(m, np.int32), alpha[i]
            for j in range(i, min(n, i + self.longest)):
                row = text[j] if live is None else text[j][live]
                state = self.next[state, row]
                ok = state != self.dead
                if not ok.all():
                    keep = np.flatnonzero(ok)
                    if not len(keep):
                        break
                    live, state = (keep if live is None else live[keep]), state[keep]
                piece = self.piece[state]
                has = np.flatnonzero(piece >= 0)
                if not len(has):
                    continue
                who = has if live is None else live[has]
                if len(has) == m:
                    who = slice(None)
                piece = piece[has]
                alpha[j + 1, who] = np.logaddexp(alpha[j + 1, who], start[who] + self.log_weight[piece])
                if counts is not None:
                    arcs.append((i, j + 1, who, piece))
        if counts is not None:
            beta = np.full((n + 1, m), -np.inf)
            beta[n] = 0
            for i, j, who, piece in reversed(arcs):
                through = self.log_weight[piece] + beta[j, who]
                beta[i, who] = np.logaddexp(beta[i, who], through)
                share = np.exp(alpha[i, who] + through - alpha[n, who]) * counts[who]
                expected += np.bincount(piece, share, len(expected))
        return alpha[n]


def _distinct(data: np.ndarray, offsets: np.ndarray) -> tuple:
    """Word hashes and text numbers, their codes, and each distinct word's hash and place."""
    low = LOWER[data]
    starts, lens, doc = spans_of_words(low, offsets)
    words = span_hash(low, starts, lens)
    codes, first = pd.factorize(words)
    where = np.empty(len(first), np.int64)
    where[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    raw = low.tobytes()
    names = [MARK + raw[a:b] for a, b in zip(starts[where].tolist(), (starts + lens)[where].tolist(), strict=True)]
    return doc, codes, first, names


def _merge(keys: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, sums = keys[order], sums[order]
    if not len(keys):
        return keys, sums
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(sums, first)


def _batch(names: list[str], kinds: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))})


_COUNTED = "bucket int, words binary, counts binary"
_ALL = -1
#: Numbers of the totals that share a bucket; parts of them meet in buckets -1, -2 and so on.
_PART = 128


def _bucket_of(words: np.ndarray, buckets: int) -> np.ndarray:
    return ((words >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _count(df: DataFrame, shipped: Broadcast, buckets: int, rounds: int) -> DataFrame:
    """Merged word counts by bucket; the negative ones hold parts of [tokens, texts, expected piece counts]."""
    names, kinds = ["bucket", "words", "counts"], [pa.int32(), pa.binary(), pa.binary()]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: Pieces = shipped.value
        whole = np.zeros(2 + len(pieces.names))
        for _, data, offsets in text_slices(batches, limit=16 << 20):
            doc, codes, first, words = _distinct(data, offsets)
            sums = np.bincount(codes, minlength=len(first))
            whole[:2] += len(codes) + len(offsets) - 1, len(offsets) - 1
            if rounds:
                whole[2:] += pieces.forward(words, sums)[1]
            owner = _bucket_of(first, buckets)
            order = np.argsort(owner, kind="stable")
            at = np.searchsorted(owner[order], np.arange(buckets + 1))
            yield _batch(names, kinds, [(b, first[order[at[b] : at[b + 1]]].tobytes(), sums[order[at[b] : at[b + 1]]].astype(np.int64).tobytes()) for b in range(buckets) if at[b] < at[b + 1]])
        if whole[1]:
            yield _batch(names, kinds, [(_ALL - i // _PART, b"", whole[i : i + _PART].tobytes()) for i in range(0, len(whole), _PART) if whole[i : i + _PART].any()])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, keys, sums, size = None, [], [], 0

        def done() -> pa.RecordBatch:
            if held <= _ALL:
                return _batch(names, kinds, [(held, b"", np.sum(sums, 0).tobytes())])
            k, s = _merge(np.concatenate(keys), np.concatenate(sums))
            return _batch(names, kinds, [(held, k.tobytes(), s.tobytes())])

        for batch in batches:
            for r in batch.to_pylist():
                if r["bucket"] != held:
                    if held is not None:
                        yield done()
                    held, keys, sums, size = r["bucket"], [], [], 0
                if held <= _ALL:
                    sums = [np.sum([*sums, np.frombuffer(r["counts"])], 0)]
                    continue
                keys.append(np.frombuffer(r["words"], np.uint64))
                sums.append(np.frombuffer(r["counts"], np.int64))
                size += len(keys[-1])
                if size > 1 << 20 and len(keys) > 1 and size > 2 * len(keys[0]):
                    k, s = _merge(np.concatenate(keys), np.concatenate(sums))
                    keys, sums, size = [k], [s], len(k)
        if held is not None:
            yield done()

    parts = df.mapInArrow(count, _COUNTED)
    return parts.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(merge, _COUNTED)


def _frequent(counted: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray, int]:
    """About FREQUENT of the most frequent words with their counts, and the number of distinct words."""
    each = max(1, FREQUENT // buckets)
    names, kinds = ["words", "counts", "n"], [pa.binary(), pa.binary(), pa.int64()]

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                k, s = np.frombuffer(r["words"], np.uint64), np.frombuffer(r["counts"], np.int64)
                pick = np.argpartition(-s, each)[:each] if len(s) > each else np.arange(len(s))
                yield _batch(names, kinds, [(k[pick].tobytes(), s[pick].tobytes(), len(k))])

    rows = counted.where(F.col("bucket") >= 0).mapInArrow(top, "words binary, counts binary, n long").collect()
    k = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r.words, np.uint64) for r in rows)])
    s = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r.counts, np.int64) for r in rows)])
    order = np.argsort(k)
    return k[order], s[order], sum(r.n for r in rows)


def score(df: DataFrame, vocabulary: str, train: DataFrame | None = None, text: str = "text", key: str = "doc_id", keep: tuple[str, ...] = (), rounds: int = 1, buckets: int | None = None) -> DataFrame:
    """Scores of every whole text: the ``keep`` columns and n_tokens, n_known, train_tokens, base_score, score.

    ``train`` (default: ``df``) gives the word counts and the piece weights.  Texts are
    lower-cased A-Z and cut at ASCII white space; one end mark follows the words.  A null
    or empty text is the end mark alone.  Repeated rows are scored each; an empty ``df``
    gives an empty result; an empty ``train`` leaves the vocabulary's own weights and
    known words nowhere.  ``keep`` columns must not bear the names above, which raises
    ValueError.  ``buckets`` is the number of word groups; more make smaller tasks.
    ``rounds=0`` leaves the vocabulary's own weights as they are.
    """
    if clash := {c.lower() for c in keep} & {"n_tokens", "n_known", "train_tokens", "base_score", "score"}:
        raise ValueError(f"columns to keep have names of results: {', '.join(sorted(clash))}")
    spark: SparkSession = df.sparkSession
    scratch.on_workers(spark)
    buckets = buckets or max(32, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pieces = Pieces(*Pieces.read(vocabulary))
    source = (df if train is None else train).select(F.col(text).alias("text"))
    counted = scratch.write(_count(source, spark.sparkContext.broadcast(pieces), buckets, rounds), "words")
    total = np.zeros(2 + len(pieces.names))
    for r in counted.where(F.col("bucket") <= _ALL).collect():
        at = (_ALL - r.bucket) * _PART
        total[at : at + _PART] = np.frombuffer(r.counts)
    n_train, n_texts = int(total[0]), int(total[1])
    if rounds and n_texts:
        w = total[2:] + PRIOR * np.exp(pieces.log_weight)
        pieces.log_weight = np.log(w / w.sum())
    known, known_count, distinct = _frequent(counted, buckets)
    v = distinct + (n_texts > 0)
    denominator = n_train + 0.5 * (v + 1)
    log_end = math.log10((n_texts or 1) / (n_train or 2)) if n_texts < n_train or not n_train else 0.0
    log_more = math.log10(1 - (n_texts or 1) / (n_train or 2)) if n_texts < n_train or not n_train else -math.inf
    shipped = spark.sparkContext.broadcast((pieces, known, known_count))

    fields = [f for f in df.schema.fields if f.name in keep]
    slim = df.select(*(F.col(c) for c in keep), F.col(text).alias("_text")).select(F.struct(*keep).alias("_keep") if keep else F.struct(F.lit(0).alias("_")).alias("_keep"), F.col("_text").alias("text"))
    kept_type = slim.schema["_keep"].dataType.simpleString()
    # One row per slice holds its texts (bucket -1, as a list); one per slice and bucket its rare words.
    schema = f"bucket int, slice string, kind int, kept array<{kept_type}>, a binary, b binary, c binary"
    cols = ["bucket", "slice", "kind", "kept", "a", "b", "c"]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        pieces, known, known_count = shipped.value
        seen, logs = np.zeros(0, np.uint64), np.zeros(0)
        for rows, data, offsets in text_slices(batches):
            n, name = len(offsets) - 1, uuid.uuid4().hex
            doc, codes, first, words = _distinct(data, offsets)
            # Word probabilities, kept from slice to slice.
            at = np.searchsorted(seen, first)
            old = np.zeros(len(first), bool) if not len(seen) else seen[np.minimum(at, len(seen) - 1)] == first
            p = np.empty(len(first))
            p[old] = logs[at[old]]
            fresh = np.flatnonzero(~old)
            if len(fresh):
                p[fresh] = pieces.forward([words[i] for i in fresh])[0] / math.log(10)
                if len(seen) > 1 << 20:
                    seen, logs, at = np.zeros(0, np.uint64), np.zeros(0), np.zeros(len(first), np.int64)
                fresh = fresh[np.argsort(first[fresh])]
                logs, seen = np.insert(logs, at[fresh], p[fresh]), np.insert(seen, at[fresh], first[fresh])
            tokens = np.bincount(doc, minlength=n) + 1
            score = np.bincount(doc, p[codes], n) + (tokens - 1) * (log_more if tokens.max() > 1 else 0.0) + log_end
            # Frequent words are known here; the others go to their buckets.
            at = np.minimum(np.searchsorted(known, first), max(0, len(known) - 1))
            here = known[at] == first if len(known) else np.zeros(len(first), bool)
            count = known_count[at] if len(known) else np.zeros(len(first), np.int64)
            mine = here[codes]
            base = np.bincount(doc[mine], np.log10((count[codes[mine]] + 0.5) / denominator), n) + math.log10((n_texts + 0.5) / denominator)
            n_known = np.bincount(doc[mine], minlength=n) + (n_texts > 0)
            out = [(_ALL, name, 0, column(rows, "_keep").to_pylist(), tokens.astype(np.int64).tobytes(), n_known.astype(np.int64).tobytes(), np.concatenate([base, score]).tobytes())]
            rare = ~mine
            word, where = first[codes[rare]], doc[rare].astype(np.uint32)
            owner = _bucket_of(word, buckets)
            order = np.argsort(owner, kind="stable")
            ends = np.searchsorted(owner[order], np.arange(buckets + 1))
            out += [(b, name, n, None, word[part].tobytes(), where[part].tobytes(), None) for b in range(buckets) if len(part := order[ends[b] : ends[b + 1]])]
            yield pa.RecordBatch.from_pydict({c: pa.array([r[i] for r in out], k) for i, (c, k) in enumerate(zip(cols, arrow_kinds, strict=True))})

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import ArrayType

    arrow_kinds = [pa.int32(), pa.string(), pa.int32(), to_arrow_type(ArrayType(slim.schema["_keep"].dataType)), pa.binary(), pa.binary(), pa.binary()]
    looked = scratch.write(slim.mapInArrow(look, schema), "looked")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, keys, sums = None, None, None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["kind"] < 0:
                    held, keys, sums = r["bucket"], np.frombuffer(r["a"], np.uint64), np.frombuffer(r["b"], np.int64)
                    continue
                word, where, n = np.frombuffer(r["a"], np.uint64), np.frombuffer(r["b"], np.uint32), r["kind"]
                count = np.zeros(len(word), np.int64)
                if held == r["bucket"] and len(keys):
                    at = np.minimum(np.searchsorted(keys, word), len(keys) - 1)
                    count = np.where(keys[at] == word, sums[at], 0)
                base, met = np.bincount(where, np.log10((count + 0.5) / denominator), n), np.bincount(where, count > 0, n)
                some = np.flatnonzero(base)
                out.append((r["slice"], some.astype(np.uint32).tobytes(), base[some].tobytes(), met[some].astype(np.uint32).tobytes()))
            if out:
                yield _batch(["slice", "a", "b", "c"], [pa.string(), pa.binary(), pa.binary(), pa.binary()], out)

    counts = counted.where(F.col("bucket") >= 0).select("bucket", F.lit("").alias("slice"), F.lit(-1).alias("kind"), F.col("words").alias("a"), F.col("counts").alias("b"))
    asked = looked.where(F.col("bucket") >= 0).select("bucket", "slice", "kind", "a", "b")
    answers = counts.unionByName(asked).repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(answer, "slice string, a binary, b binary, c binary")
    own = looked.where(F.col("bucket") == _ALL).select("slice", F.lit(0).alias("kind"), "kept", "a", "b", "c")
    parts = own.unionByName(answers.withColumn("kind", F.lit(1)), allowMissingColumns=True)

    result = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in sorted(fields, key=lambda f: keep.index(f.name))), "n_tokens long, n_known long, train_tokens long, base_score double, score double"])
    kept_names = list(keep)
    kept_kinds = [to_arrow_type(df.schema[c].dataType) for c in keep]

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def done() -> pa.RecordBatch:
            kept, tokens, met, base, points = held
            own = {c: pa.array([k[c] for k in kept], t) for c, t in zip(kept_names, kept_kinds, strict=True)}
            return pa.RecordBatch.from_pydict(own | {"n_tokens": pa.array(tokens), "n_known": pa.array(met), "train_tokens": pa.array(np.full(len(tokens), n_train)), "base_score": pa.array(base), "score": pa.array(points)})

        for batch in batches:
            for r in batch.to_pylist():
                if r["kind"] == 0:
                    if held is not None:
                        yield done()
                    both = np.frombuffer(r["c"])
                    held = r["kept"], np.frombuffer(r["a"], np.int64), np.frombuffer(r["b"], np.int64).copy(), both[: len(both) // 2].copy(), both[len(both) // 2 :]
                else:
                    where = np.frombuffer(r["a"], np.uint32)
                    held[3][where] += np.frombuffer(r["b"])
                    held[2][where] += np.frombuffer(r["c"], np.uint32)
        if held is not None:
            yield done()

    return parts.repartition("slice").sortWithinPartitions("slice", "kind").mapInArrow(combine, result)
