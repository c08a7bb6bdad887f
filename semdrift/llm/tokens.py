"""Token counts of whole texts with a whole-token shortcut.

The vocabulary decides two things offline. First, no piece holds a space sign behind another character, so no
merge crosses the start of a word, and a text's tokens are those of its words. Second, a vocabulary string that
encodes alone as one token counts 1 wherever it stands as a word. Words outside that table are merged by the
library, once per batch for each distinct word, and remembered in a bounded table.

Null and empty texts have no tokens. Every row is counted, repeated ids included. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
# Words remembered besides the whole tokens; the table starts anew beyond that.
REMEMBERED = 300_000
# Longest word that is remembered.
WORD_CHARS = 64


class Counter:
    """Counts tokens of texts for one sentencepiece model whose normaliser changes nothing but spaces."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        plain = [p for i in range(n) if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i)) for p in [self.model.id_to_piece(i)]]
        # The proof that words can be counted one by one; a line feed, which no piece holds, is a token of
        # its own, so text can be cut in front of it as well. A model without this has its texts encoded whole.
        apart = not any(re.search(f"[^{SPACE}]{SPACE}|\n", p) for p in plain)
        self.by_word = apart and self._keeps_text() and self._size("\n") == 2
        words = [p[1:] for p in plain if p.startswith(SPACE) and len(p) > 1 and SPACE not in p[1:]]
        self.whole = {w: 1 for w, ids in zip(words, self.model.encode(words), strict=True) if len(ids) == 1}
        self.known = dict(self.whole)

    def _size(self, text: str) -> int:
        return len(self.model.encode(text))

    def _keeps_text(self) -> bool:
        probe = " a  B\tééﬁ　  Ω <s> \n x "
        return self.model.normalize(probe) == SPACE + probe.replace(" ", SPACE) and self._size("") == 0

    def counts(self, texts: list[str | None]) -> list[int]:
        split = [self._words(t) if t else [] for t in texts]
        new = set().union(*(w for w in split if w is not None)).difference(self.known)
        if len(self.known) + len(new) > REMEMBERED + len(self.whole):
            self.known = dict(self.whole)
            new = set().union(*(w for w in split if w is not None)).difference(self.known)
        self.known.update(self._measure([w for w in new if len(w) <= WORD_CHARS]))
        long = [w for w in new if len(w) > WORD_CHARS]
        known = (self.known | dict(self._measure(long)) if long else self.known).__getitem__
        return [self._size(t) if words is None else sum(map(known, words)) for t, words in zip(texts, split, strict=True)]

    def _measure(self, words: list[str]) -> Iterator[tuple[str, int]]:
        """Tokens of each word. One that begins with a line feed has no space sign in front."""
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            for w, ids in zip(part, self.model.encode(part), strict=True):
                yield w, len(ids) - w.startswith("\n")

    def _words(self, text: str) -> list[str] | None:
        """Words that can be encoded alone, or None for a text that is to be encoded whole: spaces that
        do not just part two words, or a space sign in the text itself."""
        if not self.by_word or text[0] in " \n" or text[-1] == " " or "  " in text or " \n" in text or SPACE in text:
            return None
        return text.replace("\n", " \n").split(" ")


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row. ``model_path`` must exist on every executor."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(model_path)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                n = pa.array(counter.counts(batch["text"].to_pylist()), pa.int64())
                yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_bytes"], n], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).alias("text"))
    schema = rows.select("doc_id", "n_bytes", F.lit(0).cast("long").alias("n_tokens")).schema
    return rows.mapInArrow(count, schema).withColumn("over_limit", F.col("n_tokens") > limit)
