"""Token counts under a unigram vocabulary, by dynamic programming over a trie.

The distinct words of a batch are sorted, which is a walk through their trie: what a word
shares with the one before is on the stack already. Each node holds the forward score of its
prefix (the best sum of piece scores over all ways to cut it, and how many pieces that
takes), so a shared prefix is computed once, and the node where a word ends gives its count.
Documents then add up the counts of their words; nothing is shuffled.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.llm.common import TwoGenerations, map_rows, process_cache, table, text_bytes, with_columns

START = "▁"
"""Begins every word, as in the vocabulary."""
CACHE_WORDS = 250_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def piece_score(rank: int) -> int:
    """Millionths of the natural logarithm of a Zipf weight, for the piece of this rank."""
    return -round(1e6 * math.log(rank + 3))


class Unigram:
    """Pieces of a vocabulary file with scores by rank; bytes stand in for unknown characters."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        import sentencepiece

        file = sentencepiece.SentencePieceProcessor(model_file=path)
        usable = [i for i in range(file.get_piece_size()) if not (file.is_control(i) or file.is_unknown(i) or file.is_byte(i))]
        self.scores = {file.id_to_piece(i): piece_score(n) for n, i in enumerate(usable)}
        self.byte = piece_score(len(usable))
        self.longest = max(map(len, self.scores))
        self.words = TwoGenerations(cache_words)

    def count_sorted(self, words: list[str]) -> list[tuple[int, int]]:
        """(score, pieces) of each of the sorted ``words``, prefixes once each.

        Higher score wins, then fewer pieces.
        """
        scores, longest = self.scores, self.longest
        stack: list[tuple[int, int]] = [(0, 0)]  # (score, -pieces) of the prefix of each length
        before, out = "", []
        for word in words:
            same = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                same += 1
            del stack[same + 1 :]
            for end in range(same + 1, len(word) + 1):
                last = len(word[end - 1].encode("utf-8", "replace"))
                score, pieces = stack[end - 1]
                best = (score + last * self.byte, pieces - last)
                for start in range(max(0, end - longest), end):
                    piece = scores.get(word[start:end])
                    if piece is not None:
                        score, pieces = stack[start]
                        if (way := (score + piece, pieces - 1)) > best:
                            best = way
                stack.append(best)
            before = word
            out.append((stack[-1][0], -stack[-1][1]))
        return out

    def learn(self, words: set[bytes]) -> dict[bytes, tuple[int, int]]:
        """(score, pieces) of ``words``, from the cache or by the trie."""
        found, new = {}, []
        for w in words:
            known = self.words.young.get(w) or self.words.old.get(w)
            if known is None:
                new.append((START + w.decode("utf-8", "replace"), w))
            else:
                found[w] = known
        new.sort()
        for (_, w), result in zip(new, self.count_sorted([x for x, _ in new])):
            found[w] = result
            if len(w) <= 64:
                self.words.missing(w, lambda _, r=result: r)
        return found


def model(path: str) -> Unigram:
    kept = process_cache("unigram")
    if path not in kept:
        kept[path] = Unigram(path)
    return kept[path]


def count_tokens(docs: DataFrame, path: str | None = None, batch_bytes: int = 1 << 22) -> DataFrame:
    """``docs`` without ``text``, with n_words, n_tokens and log_score (millionths), all long.

    Words are separated by ASCII white space. Null text: no words, zeros. Null ids and
    repeated rows: a row each. Empty table: no rows. Columns of those names are replaced.
    """
    where = path or default_path()
    made = ("n_words", "n_tokens", "log_score")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in (*made, "text")]).alias("row")
    source = docs.select(row, text_bytes())

    def work(batch):
        unigram, out, held, size = model(where), [], [], 0

        def settle():
            known = unigram.learn(set().union(*held))
            for words in held:
                counted = [known[w] for w in words]
                out.append((len(words), sum(c for _, c in counted), sum(s for s, _ in counted)))

        for text in batch.column(1).to_pylist():
            held.append(text.split())
            size += len(text)
            if size >= batch_bytes:
                settle()
                held, size = [], 0
        settle() if held else None
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), pa.int64()) for c in zip(*out))], ["row", *made])

    return map_rows(source, with_columns(source, "n_words long, n_tokens long, log_score long"), work).select("row.*", *made)


def op5_trie_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op5_trie_counts": op5_trie_counts}
