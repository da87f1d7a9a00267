"""Token counts under a unigram model, by dynamic programming over a trie of pre-tokens.

A pre-token is a white-space word with the word mark in front. Its tokens are the best segmentation into vocabulary
pieces, the one with the largest sum of scores; a character that no piece covers counts as its UTF-8 bytes. The forward
score of a prefix (best sum of scores, and fewest tokens among the best) depends on the prefix alone, so distinct
pre-tokens go into a trie and each of its nodes is scored once; a node that ends a pre-token holds its count. A task
keeps its trie from text to text, up to a stated number of nodes.

The vocabulary is a parameter and is never trained. Of the files at hand none is of the unigram kind, so a merge
vocabulary's pieces are scored by their rank; a file with unigram scores can be given as pieces as it is.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def load_pieces(path: str = VOCABULARY) -> dict[str, float]:
    """Piece -> score from a sentencepiece file, read on the driver; control and byte pieces are left out.

    The file of a merge vocabulary holds ranks for scores, so a piece's probability is taken from its rank by Zipf's
    law: log(1 / (rank * H)), with ranks from 1 and H the harmonic number of the pieces.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=os.path.realpath(path))
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    ids.sort(key=lambda i: (-model.get_score(i), i))
    norm = math.log(sum(1 / r for r in range(1, len(ids) + 1)))
    return {model.id_to_piece(i): -math.log(r) - norm for r, i in enumerate(ids, 1)}


class Segmenter:
    """A trie of the pre-tokens seen; emptied when full, which costs time and changes nothing.

    Node n has the forward score and the tokens of its prefix; its child for a character is found under (n, character)
    as one number. ends holds the count of each pre-token, which is that of its last node.
    """

    def __init__(self, pieces: dict[str, float], most: int = 2_000_000) -> None:
        self.pieces, self.most = pieces, most
        self.longest = max(map(len, pieces), default=1)
        self.worst = min(pieces.values(), default=0.0) - 10.0  # of a byte
        self.forget()

    def forget(self) -> None:
        self.scores, self.tokens = [0.0], [0]  # of the root
        self.children: dict[int, int] = {}
        self.ends: dict[str, int] = {}

    def learn(self, words: Iterable[str]) -> None:
        """Insert words, in order, so that each goes on from where it leaves the one before; only new nodes are scored."""
        pieces, longest, worst, children, scores, tokens = self.pieces.get, self.longest, self.worst, self.children, self.scores, self.tokens
        last, path, gone = "", [0], [0.0]  # the nodes of the current path and their scores
        for word in sorted(words):
            text, common = MARK + word, 0
            for a, b in zip(last, text, strict=False):
                if a != b:
                    break
                common += 1
            del path[common + 1 :], gone[common + 1 :]
            node = path[-1]
            for end in range(common + 1, len(text) + 1):
                letter = text[end - 1]
                key = node << 21 | ord(letter)
                known = children.get(key)
                if known is None:
                    size = 1 if letter < "\x80" else len(letter.encode("utf-8", "replace"))
                    best, fewest = gone[-1] + size * worst, tokens[node] + size
                    for start in range(end - longest if end > longest else 0, end):
                        score = pieces(text[start:end])
                        if score is not None:
                            score += gone[start]
                            if score > best or score == best and tokens[path[start]] + 1 < fewest:
                                best, fewest = score, tokens[path[start]] + 1
                    known = children[key] = len(scores)
                    scores.append(best)
                    tokens.append(fewest)
                node = known
                path.append(node)
                gone.append(scores[node])
            last = text
            self.ends[word] = tokens[node]

    def count(self, texts: list[str | None]) -> list[tuple[int, int]]:
        """(tokens, pre-tokens) of each text."""
        out = []
        for i in range(0, len(texts), 256):
            split = [(t or "").split() for t in texts[i : i + 256]]
            if len(self.scores) > self.most:
                self.forget()
            self.learn({w for words in split for w in words}.difference(self.ends))
            at = self.ends.__getitem__
            out += [(sum(map(at, words)), len(words)) for words in split]
        return out


def token_counts(docs: DataFrame, pieces: dict[str, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_words for every row of docs.

    Null, empty and blank texts have no tokens. Repeated rows each give a row, null ids stay null, and an empty table
    gives an empty result. Words are separated by Unicode white space. Other columns are not read. The vocabulary, of a
    stated file and so of bounded size, is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = Segmenter(shared.value)
        for batch in batches:
            got = segmenter.count(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in got], pa.int64()), pa.array([w for _, w in got], pa.int64())], names=["doc_id", "n_tokens", "n_words"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, n_words long")
