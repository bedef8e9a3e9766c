"""BPE encoding and decoding of whole texts by tree concatenation.

A text is cut at white space, where no token ever crosses; words are encoded once and kept
in a bounded cache. A piece that has no cut inside and is long (a run of letters, of signs)
is encoded in halves: the halves are encoded independently, and at each join a window of a
few tokens to both sides is encoded again and grown until its first token equals the left
half's token at that place and its last token the right half's. Merge-ordered encodings are
right exactly when every neighbouring pair is, so agreement at both ends makes the whole
sequence exact. Pieces too long for one task's share are spread over rows first.
"""

from __future__ import annotations

import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.llm.common import TwoGenerations, map_rows, process_cache, table, text_bytes, with_columns

LEAF = 256
"""Characters that are encoded without halving."""
LONG_RUN = 32768
"""Bytes without white space from which the leaves of a run become rows of their own."""
CACHE_WORDS = 120_000
"""Words in each half of a worker's cache."""

_SIMPLE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
# what the pattern above and lower() treat as the file's own rules do: printable ASCII and
# the Latin-1 letters, which are composed already
_KNOWN = re.compile("[!-~À-ÖØ-öø-ÿ]+")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: a printable stands for itself, others are numbered from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in printable)
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = _byte_letters()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Encoder for a ``tokenizers`` file of word BPE with a word-end suffix."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS, leaf: int = LEAF):
        from tokenizers import Tokenizer, models

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        vocab = parts["model"]["vocab"]
        merges = [tuple(m) for m in parts["model"]["merges"]]
        self.leaf = leaf
        # a piece that ends its word, and one that goes on
        self.ending = models.BPE(
            vocab=vocab, merges=merges, end_of_word_suffix=parts["model"]["end_of_word_suffix"]
        )
        self.going_on = models.BPE(vocab=vocab, merges=merges)
        self.names = {i: t for t, i in vocab.items()}
        self.added = {t["content"]: t["id"] for t in parts["added_tokens"]}
        self.names.update({i: t for t, i in self.added.items()})
        self.added_bytes = re.compile(
            b"(" + b"|".join(re.escape(t.encode()) for t in self.added) + b")"
        )
        self.packed = {i: i.to_bytes(4, "little") for i in self.names}
        self.named = {b: self.names[i].encode() for i, b in self.packed.items()}
        self.pieces = TwoGenerations(cache_words)
        self.words = TwoGenerations(cache_words)
        self.pairs = TwoGenerations(cache_words)

    # -- pieces without a cut inside ------------------------------------------------
    def leaf_tokens(self, piece: str, last: bool) -> list[tuple[int, int]]:
        """(id, characters) of a leaf; ``last`` says whether it ends its word."""
        model = self.ending if last else self.going_on
        out = []
        for token in model.tokenize(piece):
            begin, end = token.offsets
            out.append((token.id, len(piece.encode()[begin:end].decode())))
        return out

    def join(self, piece: str, left: list, right: list, last: bool) -> list[tuple[int, int]]:
        """Tokens of ``piece`` from those of its two halves, by a growing window."""
        if not left or not right:
            return left + right
        width = 4
        middle = sum(n for _, n in left)
        while True:
            a, b = max(0, len(left) - width), min(len(right), width)
            begin = middle - sum(n for _, n in left[a:])
            end = middle + sum(n for _, n in right[:b])
            window = self.leaf_tokens(piece[begin:end], last and b == len(right))
            if (a == 0 or window[0] == left[a]) and (b == len(right) or window[-1] == right[b - 1]):
                return left[:a] + window + right[b:]
            width *= 2

    def tree(self, piece: str, last: bool = True) -> list[tuple[int, int]]:
        if len(piece) <= self.leaf:
            return self.leaf_tokens(piece, last)
        half = len(piece) // 2
        return self.join(piece, self.tree(piece[:half], False), self.tree(piece[half:], last), last)

    def _piece_ids(self, piece: str) -> bytes:
        packed = self.packed
        if len(piece) <= self.leaf:
            return b"".join([packed[t.id] for t in self.ending.tokenize(piece)])
        return b"".join([packed[i] for i, _ in self.tree(piece)])

    # -- words ----------------------------------------------------------------------
    def split_word(self, word: bytes) -> list[str]:
        """Byte-level pieces of a run without white space."""
        text = word.decode("utf-8", "replace")
        if _KNOWN.fullmatch(text):
            pieces = _SIMPLE.findall(text.lower())
            if len(text) == len(word):
                return pieces
            return [p.encode().decode("latin-1").translate(_LETTERS) for p in pieces]
        text = self.tokenizer.normalizer.normalize_str(text)
        return [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def _word(self, word: bytes) -> bytes:
        """Ids of a word as little-endian unsigned 32-bit numbers."""
        get, missing, make = self.pieces.young.get, self.pieces.missing, self._piece_ids
        return b"".join([get(p) or missing(p, make) for p in self.split_word(word)])

    def _pair(self, word: bytes) -> tuple[bytes, bytes]:
        ids = self._word(word)
        return ids, self.named_run(ids)

    def named_run(self, ids: bytes) -> bytes:
        """Decoded form: the tokens' own spellings with blanks between."""
        return b" ".join([self.named[ids[i : i + 4]] for i in range(0, len(ids), 4)])

    def _runs(self, text: bytes, cache: TwoGenerations, make, added) -> list:
        """``make`` of every run without white space, ``added`` of every special token."""
        get, missing = cache.young.get, cache.missing
        if b"<|" in text and self.added_bytes.search(text):
            out = []
            for k, part in enumerate(self.added_bytes.split(text)):
                out += [added(part)] if k % 2 else self._runs(part, cache, make, added)
            return out
        return [get(w) or missing(w, make) for w in text.lower().split()]

    def added_ids(self, token: bytes) -> bytes:
        return self.packed[self.added[token.decode()]]

    def encode(self, text: bytes) -> list[tuple[bytes, bytes]]:
        """(ids as little-endian unsigned 32 bit, decoded tokens) of every run in ``text``."""
        return self._runs(text, self.pairs, self._pair, lambda t: (self.added_ids(t), t))

    def ids(self, text: bytes) -> bytes:
        return b"".join(self._runs(text, self.words, self._word, self.added_ids))


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for this file, made once."""
    kept = process_cache("bpe")
    if path not in kept:
        kept[path] = WordEncoder(path)
    return kept[path]


def digests(coded: list[tuple[bytes, bytes]]) -> tuple[int, str, str]:
    ids = b"".join([x[0] for x in coded])
    decoded = b" ".join([x[1] for x in coded if x[1]])
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()


def encode_texts(df: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """``df`` with ``ids`` (array of int) and ``decoded`` in place of nothing: all columns stay.

    A null text counts as empty and gives an empty array and an empty string. Columns of
    ``df`` that are already called ``ids`` or ``decoded`` are replaced.
    """
    where = path or default_path()
    kept = [F.col(f"`{c}`") for c in df.columns if c not in ("ids", "decoded")]
    source = df.select(F.struct(*kept).alias("row"), text_bytes(text))

    def work(batch):
        enc = encoder(where)
        coded = [enc.encode(t) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([_numbers(b"".join([x[0] for x in c])) for c in coded], pa.list_(pa.int32())),
                pa.array([b" ".join([x[1] for x in c if x[1]]).decode() for c in coded], pa.string()),
            ],
            ["row", "ids", "decoded"],
        )

    out = map_rows(source, with_columns(source, "ids array<int>, decoded string"), work)
    return out.select("row.*", "ids", "decoded")


def _numbers(ids: bytes) -> list[int]:
    import numpy as np

    return np.frombuffer(ids, "<u4").astype("int32")


def encode_digests(
    df: DataFrame, path: str | None = None, long_run: int = LONG_RUN
) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) per row of (doc_id, text).

    Null text: empty, no tokens, the digests of nothing. Null and repeated ids: one row per
    input row. Empty table: no rows. Other columns are not read.
    """
    where = path or default_path()
    source = df.select("doc_id", text_bytes())
    unsplit = F.col("text").cast("string").rlike("[^ \\t\\n\\x0B\\f\\r]{%d,}" % long_run)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def whole(batch):
        enc = encoder(where)
        rows = [digests(enc.encode(t)) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), *(pa.array(list(c), k) for c, k in zip(zip(*rows), (pa.int64(), pa.string(), pa.string())))],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    short = map_rows(source.where(~unsplit), schema, whole)
    return short.unionByName(_by_leaves(source.where(unsplit), where, schema))


def _by_leaves(source: DataFrame, where: str, schema: str) -> DataFrame:
    """Texts with very long runs: their leaves are rows, encoded apart and joined per text."""

    def cut(batch):
        """Rows of leaves; everything between long pieces is encoded here."""
        enc, rows = encoder(where), []
        for key, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            part = 0
            for k, span in enumerate(enc.added_bytes.split(text)):
                if k % 2:
                    rows.append((key, doc_id, part, 0, 1, None, enc.added_ids(span)))
                    part += 1
                    continue
                for word in span.lower().split():
                    pieces = enc.split_word(word) if len(word) > enc.leaf else []
                    if all(len(p) <= enc.leaf for p in pieces):
                        rows.append((key, doc_id, part, 0, 1, None, enc._word(word)))
                        part += 1
                        continue
                    for p in pieces:
                        leaves = 1
                        while len(p) > leaves * enc.leaf:
                            leaves *= 2
                        step = -(-len(p) // leaves)
                        cuts = [p[i : i + step] for i in range(0, len(p), step)]
                        rows += [(key, doc_id, part, n, len(cuts), c, None) for n, c in enumerate(cuts)]
                        part += 1
        names = ["key", "doc_id", "part", "leaf", "leaves", "piece", "ids"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        columns = list(zip(*rows)) if rows else [()] * 7
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)

    def encode_leaf(batch):
        enc = encoder(where)
        out = []
        for leaf, leaves, piece in zip(*(batch.column(n).to_pylist() for n in ("leaf", "leaves", "piece"))):
            tokens = enc.leaf_tokens(piece, leaf == leaves - 1) if piece is not None else []
            out.append(json.dumps(tokens))
        return batch.append_column("tokens", pa.array(out, pa.string()))

    def finish(group):
        enc, ids = encoder(where), []
        group = group.sort_values(["part", "leaf"], kind="stable")
        for _, part in group.groupby("part", sort=True):
            if part["piece"].iloc[0] is None:
                ids.append(part["ids"].iloc[0])
                continue
            level = [(p, [tuple(x) for x in json.loads(t)]) for p, t in zip(part["piece"], part["tokens"])]
            while len(level) > 1:
                pairs = []
                for i in range(0, len(level) - 1, 2):
                    (p, left), (q, right) = level[i], level[i + 1]
                    pairs.append((p + q, enc.join(p + q, left, right, i + 2 == len(level))))
                level = pairs + level[len(level) - len(level) % 2 :]
            ids += [enc.packed[i] for i, _ in level[0][1]]
        import pandas as pd

        n, a, b = digests([(i, enc.named_run(i)) for i in ids])
        return pd.DataFrame({"doc_id": group["doc_id"].iloc[:1].astype("Int64"), "n_tokens": n, "ids_sha256": a, "decoded_sha256": b})

    # the digest of a text decides its result, so rows of one id and one text may share it
    keyed = source.select(F.expr("uuid()").alias("key"), "doc_id", "text")
    from tablemill.session import materialize

    keyed = materialize(keyed, "unsplit")
    leaf = "key string, doc_id long, part long, leaf long, leaves long, piece string, ids binary"
    leaves = map_rows(keyed, leaf, cut).repartition("key", "part", "leaf")
    return map_rows(leaves, f"{leaf}, tokens string", encode_leaf).groupBy("key").applyInPandas(finish, schema)


def op2_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"))


QUERIES = {"op2_bpe_tree": op2_bpe_tree}
