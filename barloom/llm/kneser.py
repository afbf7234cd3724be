"""Interpolated modified Kneser-Ney bigram model, counted in Spark, kept as sorted hash arrays.

Counting. Each task counts the words and word pairs of its training texts by fingerprint and
emits them as packed blocks, one for each shard, so a frequent word costs a task one entry.
Word shards are ranges of the fingerprint and pair shards those of the pair's: neither is skewed.
There is a shard for every ``SHARD_BYTES`` of text, so that each is merged in bounded memory.

Storage. Each shard's task writes sorted arrays (fingerprints and counts) into the shared
folder: pairs, words, and for each word what it does as a context (total, and how many pairs
were seen once, twice, more often) and how many contexts it follows. Nothing is pruned, so the
model grows with the text. Counts of pairs take two bytes, and those beyond stand in an array of
their own. Only global sums (counts of counts) reach the driver.

Scoring. Workers map the arrays into memory (a store without local paths is copied to an
unlinked temporary file first) and look up the distinct words and pairs of a slice of texts.

Words are 64-bit fingerprints, pairs are counted by both of them whole and stored by a 64-bit
fingerprint of the two. Texts start with a context of their own and
end with an end token. The lowest order is the Kneser-Ney continuation probability,
interpolated with a uniform share over the training vocabulary and one unknown token.

Defined results: null text is the empty text, which is its end token alone; a null doc_id is
not held out and teaches; without training texts every token has the uniform probability 1;
rows that repeat a doc_id count and are scored each; other columns are ignored.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stash import map_batches, new_path
from .textvec import SPACED, Slice, mix, slices

END, START = np.uint64(0xE4D0E4D0E4D0E4D0), np.uint64(0x57A7057A7057A705)
HIGH = np.uint64(32)
UPPER, LOWER = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)
FLUSH, SHARD_BYTES = 2_000_000, 32 << 20
MANY = 65535

BLOCKS = "kind int, shard int, blob binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


# ---- packed blocks: sorted keys as differences, with columns of counts


def pack(keys: np.ndarray, *columns: np.ndarray) -> bytes:
    gaps = np.diff(keys, prepend=keys.dtype.type(0))
    parts = [np.array([len(keys), keys.dtype.itemsize, len(columns)], np.int64).tobytes(), gaps.view(np.uint8).reshape(len(keys), -1).T.tobytes()]
    parts += [np.asarray(c, np.uint64).view(np.uint8).reshape(len(keys), 8).T.tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(blob: bytes) -> tuple[np.ndarray, list[np.ndarray]]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, width, k = np.frombuffer(raw, np.int64, 3).tolist()
    at = 24

    def planes(size: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T.copy().view(f"<u{size}").ravel()
        at += n * size
        return out

    keys = np.cumsum(planes(width), dtype=f"<u{width}")
    return keys, [planes(8) for _ in range(k)]


def add_up(keys: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct sorted keys with the sums of their columns."""
    if not len(keys):
        return keys, columns
    by = np.argsort(keys, kind="stable")
    keys = keys[by]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], [np.add.reduceat(c[by], first) for c in columns]


def add_up_pairs(keys: np.ndarray, rest: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order of (keys, rest) with their sums. Few pairs share a key: only those are sorted by both."""
    if not len(keys):
        return keys, rest, n
    by = np.argsort(keys, kind="stable")
    keys, rest = keys[by], rest[by]
    same = keys[1:] == keys[:-1]
    mixed = np.flatnonzero(same & (rest[1:] != rest[:-1]))
    if len(mixed):
        group = np.concatenate([[0], np.cumsum(~same)])
        some = np.flatnonzero(np.isin(group, group[mixed]))
        again = some[np.lexsort((rest[some], keys[some]))]
        by[some], rest[some] = by[again], rest[again]
    first = np.flatnonzero(np.concatenate([[True], ~same | (rest[1:] != rest[:-1])]))
    return keys[first], rest[first], np.add.reduceat(n[by], first)


def merge(blobs: list[bytes], pairs: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
    both = [(unpack_pairs if pairs else unpack)(b) for b in blobs]
    keys, columns = np.concatenate([k for k, _ in both]), [np.concatenate(c) for c in zip(*(c for _, c in both))]
    if not pairs:
        return add_up(keys, columns)
    keys, *columns = add_up_pairs(keys, *columns)
    return keys, columns


def word_shard(top: np.ndarray, shards: int) -> np.ndarray:
    """By range of the top 32 bits."""
    return ((top.astype(np.uint64) * np.uint64(shards)) >> HIGH).astype(np.int64)


def pair_keys(ctx: np.ndarray, tok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two words as two numbers: their upper halves, by which pairs are sorted, and their lower halves."""
    return (ctx & UPPER) | (tok >> HIGH), (ctx << HIGH) | (tok & LOWER)


def pair_words(keys: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (keys & UPPER) | (rest >> HIGH), (keys << HIGH) | (rest & LOWER)


def pair_prints(keys: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """One fingerprint of a pair."""
    return mix(mix(keys) * np.uint64(0xD6E8FEB86659FD93) + rest)


def pair_shard(prints: np.ndarray, shards: int) -> np.ndarray:
    return word_shard(prints >> HIGH, shards)


def pack_pairs(keys: np.ndarray, rest: np.ndarray, n: np.ndarray) -> bytes:
    """Pairs by places in a list of the block's own words: a word stands there once and whole."""
    ctx, tok = pair_words(keys, rest)
    words = np.unique(np.concatenate([ctx, tok]))
    head = pack(words)
    return len(head).to_bytes(8, "little") + head + pack(np.searchsorted(words, ctx).astype(np.uint32), np.searchsorted(words, tok), n)


def unpack_pairs(blob: bytes) -> tuple[np.ndarray, list[np.ndarray]]:
    cut = 8 + int.from_bytes(blob[:8], "little")
    words, _ = unpack(blob[8:cut])
    ctx, (tok, n) = unpack(blob[cut:])
    keys, rest = pair_keys(words[ctx], words[tok])
    return keys, [rest, n]


def _cut(kind: int, keys: np.ndarray, columns: list[np.ndarray], shard: np.ndarray, shards: int, pack=pack) -> Iterator[tuple]:
    by = np.argsort(shard, kind="stable")
    edge = np.searchsorted(shard[by], np.arange(shards + 1))
    for k in range(shards):
        i = by[edge[k] : edge[k + 1]]
        if len(i):
            yield kind, k, pack(keys[i], *(c[i] for c in columns))


def _rows(rows) -> Iterator[pa.RecordBatch]:
    rows, size = list(rows), 0
    part: list[tuple] = []
    for r in rows:
        part.append(r)
        size += len(r[2])
        if size > 8 << 20:
            yield _batch(part)
            part, size = [], 0
    if part:
        yield _batch(part)


def _batch(part: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int32()), pa.array([r[1] for r in part], pa.int32()), pa.array([r[2] for r in part], pa.binary())], ["kind", "shard", "blob"])


# ---- counting


def tokens(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of a slice's texts with an end token each, their contexts, and each text's first token."""
    h = s.hashes()
    stop = s.word_at[1:] + np.arange(s.n)  # places of the end tokens
    tok = np.empty(len(h) + s.n, np.uint64)
    inner = np.ones(len(tok), bool)
    inner[stop] = False
    tok[inner] = h
    tok[stop] = END
    ctx = np.empty_like(tok)
    ctx[1:] = tok[:-1]
    first = np.concatenate([[0], stop[:-1] + 1]) if s.n else stop
    ctx[first] = START
    return tok, ctx, first


class _Words:
    """Counts of fingerprints."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, *values: np.ndarray) -> None:
        self.parts.append(self.sums(*values, np.ones(len(values[0]), np.uint64)))
        self.size += len(self.parts[-1][0])
        if len(self.parts) > 12:
            self.squeeze()

    def sums(self, keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        keys, (n,) = add_up(keys, [n])
        return keys, n

    def squeeze(self) -> None:
        self.parts = [self.sums(*map(np.concatenate, zip(*self.parts)))]
        self.size = len(self.parts[0][0])

    def take(self) -> tuple[np.ndarray, ...]:
        self.squeeze()
        out = self.parts[0]
        self.parts, self.size = [], 0
        return out


class _Pairs(_Words):
    """Counts of pairs by both of their numbers."""

    def sums(self, keys: np.ndarray, rest: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        return add_up_pairs(keys, rest, n)


def _count(batches, shards: int):
    words, pairs = _Words(), _Pairs()

    def flush():
        if pairs.size:
            k, n = words.take()
            yield from _rows(_cut(0, k, [n], word_shard(k >> HIGH, shards), shards))
            k, rest, n = pairs.take()
            yield from _rows(_cut(1, k, [rest, n], pair_shard(pair_prints(k, rest), shards), shards, pack_pairs))

    for batch in batches:
        for s in slices(batch.column(0), SPACED):
            tok, ctx, _ = tokens(s)
            words.add(tok)
            pairs.add(*pair_keys(ctx, tok))
            if pairs.size > FLUSH:
                pairs.squeeze()
                if pairs.size > FLUSH * 2 // 3:
                    yield from flush()
    yield from flush()


# ---- the model's files


def _fs(path: str):
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))


def write_array(folder: str, name: str, a: np.ndarray) -> None:
    """A whole file or none, whichever attempt of a task writes it."""
    fs, base = _fs(folder)
    fs.create_dir(base, recursive=True)
    part = f"{base}/.{name}-{os.getpid()}-{os.urandom(4).hex()}"
    with fs.open_output_stream(part) as f:
        f.write(np.ascontiguousarray(a).view(np.uint8))
    fs.move(part, f"{base}/{name}")


_OPEN: dict[str, np.ndarray] = {}


def read_array(folder: str, name: str, dtype: str) -> np.ndarray:
    """The array, mapped into memory."""
    path = f"{folder}/{name}"
    if path not in _OPEN:
        fs, base = _fs(path)
        info = fs.get_file_info(base)
        if info.type == pafs.FileType.NotFound or not info.size:
            _OPEN[path] = np.zeros(0, dtype)
        elif isinstance(fs, pafs.LocalFileSystem):
            _OPEN[path] = np.memmap(base, dtype, "r")
        else:
            with tempfile.NamedTemporaryFile() as local:
                with fs.open_input_stream(base) as f:
                    while piece := f.read(1 << 22):
                        local.write(piece)
                local.flush()
                _OPEN[path] = np.memmap(local.name, dtype, "r")
    return _OPEN[path]


def _by_shard(batches) -> Iterator[tuple[tuple[int, int], list[bytes]]]:
    """Blocks of one (kind, shard) after the other, from rows sorted by them."""
    now, blobs, done = None, [], []
    for batch in batches:
        for kind, shard, blob in zip(*(c.to_pylist() for c in batch.columns[:3])):
            if now != (kind, shard):
                if blobs or done:
                    yield now, done + blobs
                now, blobs, done = (kind, shard), [], []
            blobs.append(blob)
            if len(blobs) == 64:  # each block is merged once here and once at the end
                k, c = merge(blobs, kind == 1)
                done.append((pack_pairs if kind == 1 else pack)(k, *c))
                blobs = []
    if blobs or done:
        yield now, done + blobs


def _pairs(batches, folder: str, shards: int):
    """Write each shard of pairs; pass on word counts (0), contexts and followed words (2) and counts of counts (9)."""
    for (kind, shard), blobs in _by_shard(batches):
        if kind == 0:
            yield from _rows((0, shard, b) for b in blobs)
            continue
        keys, (rest, n) = merge(blobs, True)
        prints = pair_prints(keys, rest)
        by = np.argsort(prints)
        write_array(folder, f"pair-{shard}.key", prints[by])
        write_array(folder, f"pair-{shard}.n", np.minimum(n[by], MANY).astype(np.uint16))
        many = by[n[by] >= MANY]
        if len(many):
            write_array(folder, f"many-{shard}.key", prints[many])
            write_array(folder, f"many-{shard}.n", n[many])
        ctx, tok = pair_words(keys, rest)
        ones = [(n == k).astype(np.uint64) for k in (1, 2)] + [(n > 2).astype(np.uint64)]
        ctx, sums = add_up(ctx, [n, *ones])
        out = list(_cut(2, ctx, [*sums, np.zeros(len(ctx), np.uint64)], word_shard(ctx >> HIGH, shards), shards))
        low, (follows,) = add_up(tok, [np.ones(len(tok), np.uint64)])
        zero = np.zeros(len(low), np.uint64)
        out += _cut(2, low, [zero, zero, zero, zero, follows], word_shard(low >> HIGH, shards), shards)
        counts = np.array([(n == k).sum() for k in (1, 2, 3, 4)], np.int64)
        out.append((9, shard, counts.tobytes()))
        yield from _rows(out)


def _words(batches, folder: str):
    """Write each shard of words and of contexts; pass on the sums (8: tokens, distinct; 9: counts of counts)."""
    for (kind, shard), blobs in _by_shard(batches):
        if kind == 9:
            yield from _rows((9, shard, b) for b in blobs)
            continue
        keys, cols = merge(blobs)
        if kind == 0:
            write_array(folder, f"word-{shard}.key", keys)
            write_array(folder, f"word-{shard}.n", cols[0])
            yield from _rows([(8, shard, np.array([cols[0].sum(), len(keys)], np.int64).tobytes())])
        else:
            write_array(folder, f"ctx-{shard}.key", keys)
            write_array(folder, f"ctx-{shard}.n", cols[0])
            write_array(folder, f"ctx-{shard}.of", np.stack(cols[1:], axis=1))
            f = cols[4]
            yield from _rows([(7, shard, np.array([*((f == k).sum() for k in (1, 2, 3, 4)), f.sum(), (f > 2).sum()], np.int64).tobytes())])


def discounts(n: list[int]) -> list[float]:
    """D1, D2, D3+ of modified Kneser-Ney from the counts of counts 1 to 4."""
    if not n[0] or not n[1]:
        return [0.5, 0.5, 0.5]
    y = n[0] / (n[0] + 2 * n[1])
    out = []
    for k in (1, 2, 3):
        d = k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.5
        out.append(float(min(max(d, 0.05), k - 0.05)))
    return out


class Model:
    """Where the arrays are, and the sums over them."""

    def __init__(self, folder: str, shards: int, tokens: int, distinct: int, pair_d: list, word_d: list, word_n: list):
        self.folder, self.shards, self.tokens, self.distinct = folder, shards, tokens, distinct
        self.pair_d, self.word_d = pair_d, word_d
        n1, n2, _, _, self.pairs, n3 = word_n
        self.rest = (word_d[0] * n1 + word_d[1] * n2 + word_d[2] * n3) / self.pairs if self.pairs else 1.0

    def _find(self, kind: str, dtype: str, keys: np.ndarray, shard: np.ndarray, columns: dict[str, tuple[str, int]]) -> list[np.ndarray]:
        out = {c: np.zeros((len(keys), w) if w > 1 else len(keys), d) for c, (d, w) in columns.items()}
        by = np.argsort(shard, kind="stable")
        edge = np.searchsorted(shard[by], np.arange(self.shards + 1))
        for k in np.flatnonzero(np.diff(edge)):
            i = by[edge[k] : edge[k + 1]]
            have = read_array(self.folder, f"{kind}-{k}.key", dtype)
            if not len(have):
                continue
            at = np.minimum(np.searchsorted(have, keys[i]), len(have) - 1)
            ok = have[at] == keys[i]
            for c, (d, w) in columns.items():
                values = read_array(self.folder, f"{kind}-{k}.{c}", d)
                values = values.reshape(-1, w) if w > 1 else values
                out[c][i[ok]] = values[at[ok]]
        return list(out.values())

    def words(self, w: np.ndarray) -> np.ndarray:
        return self._find("word", "<u8", w, word_shard(w >> HIGH, self.shards), {"n": ("<u8", 1)})[0]

    def contexts(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of words: total as a context; pairs seen once, twice, more often, and contexts they follow."""
        return tuple(self._find("ctx", "<u8", w, word_shard(w >> HIGH, self.shards), {"n": ("<u8", 1), "of": ("<u8", 4)}))

    def pair_counts(self, prints: np.ndarray) -> np.ndarray:
        shard = pair_shard(prints, self.shards)
        n = self._find("pair", "<u8", prints, shard, {"n": ("<u2", 1)})[0].astype(np.uint64)
        many = np.flatnonzero(n == MANY)
        if len(many):
            n[many] = self._find("many", "<u8", prints[many], shard[many], {"n": ("<u8", 1)})[0]
        return n

    def log10(self, tok: np.ndarray, ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each token's training count and log10 probability after its context."""
        words, w_at = np.unique(tok, return_inverse=True)
        count = self.words(words).astype(np.float64)[w_at]
        if not self.pairs:
            return count, np.zeros(len(tok))
        both, t_at = np.unique(np.concatenate([tok, ctx]), return_inverse=True)
        total, of = self.contexts(both)
        d = np.array([0, *self.word_d])
        f = of[:, 3].astype(np.float64)
        lower = (f - d[np.minimum(f, 3).astype(int)]) / self.pairs + self.rest / (self.distinct + 1)
        gamma = np.where(total > 0, of[:, :3].astype(np.float64) @ np.array(self.pair_d) / np.maximum(total, 1), 1.0)
        prints, p_at = np.unique(pair_prints(*pair_keys(ctx, tok)), return_inverse=True)
        n = self.pair_counts(prints).astype(np.float64)
        n = n - np.array([0, *self.pair_d])[np.minimum(n, 3).astype(int)]
        h = t_at[len(tok) :]
        p = n[p_at] / np.maximum(total[h], 1) + gamma[h] * lower[t_at[: len(tok)]]
        return count, np.log10(p)


def train(texts: DataFrame) -> Model:
    """Count ``texts`` (one column) and write the model's arrays into the shared folder."""
    spark = texts.sparkSession
    size = texts.agg(F.sum(F.octet_length(texts.columns[0]))).first()[0] or 0
    shards = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    folder = new_path(spark, "kneser")
    split = lambda df: df.repartitionById(shards, F.col("shard")).sortWithinPartitions("kind", "shard")
    blocks = map_batches(texts, lambda b: _count(b, shards), BLOCKS)
    pairs = map_batches(split(blocks), lambda b: _pairs(b, folder, shards), BLOCKS)
    words = map_batches(split(pairs), lambda b: _words(b, folder), BLOCKS)
    sums = {8: np.zeros(2, np.int64), 9: np.zeros(4, np.int64), 7: np.zeros(6, np.int64)}
    for r in words.collect():  # three short sums for each shard
        sums[r["kind"]] = sums[r["kind"]] + np.frombuffer(bytes(r["blob"]), np.int64)
    return Model(folder, shards, int(sums[8][0]), int(sums[8][1]), discounts(sums[9].tolist()), discounts(sums[7][:4].tolist()), sums[7].tolist())


def _score(model: Model, batches):
    for batch in batches:
        for s in slices(batch.column(2), SPACED, limit=2 << 20):
            tok, ctx, first = tokens(s)
            count, log_p = model.log10(tok, ctx)
            base = np.log10((count + 1) / (model.tokens + model.distinct + 1))
            add = lambda x: np.add.reduceat(x, first)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(s.first, s.n),
                    batch.column(1).slice(s.first, s.n),
                    pa.array(s.counts().astype(np.int64) + 1),
                    pa.array(add((count > 0).astype(np.int64))),
                    pa.array(add(base)),
                    pa.array(add(log_p)),
                ],
                ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
            )


def language_model_scores(docs: DataFrame, parts: int = 7, held: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    doc_id = F.col("doc_id").cast("long")
    out = F.coalesce(F.crc32(doc_id.cast("string")) % parts == held, F.lit(False))
    model = train(docs.filter(~out).select("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(doc_id.alias("doc_id"), out.alias("held_out"), "text")
    scored = map_batches(rows, lambda b, m=sent: _score(m.value, b), SCORES)
    return scored.withColumn("train_tokens", F.lit(model.tokens).cast("long"))
