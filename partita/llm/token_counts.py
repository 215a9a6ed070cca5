"""Token counts of whole texts: huge ones in overlapping chunks, spliced where both encodings agree.

A text of up to a chunk is encoded at once. A longer one is cut into chunks that overlap; neighbours are
spliced at a pair of tokens that both encodings hold next to each other, with equal ids and equal offsets,
away from the ends of either chunk. Such a place is proven stable for a tokenizer that splits words by a
pattern without look-behind, marks their ends, and merges pairs within a word by rank:

* Equal ids tell whether a word ends at the place, as the last token of a word bears a mark. If one does,
  the pattern goes on from there in both, and in the whole text, with the same text ahead.
* If none does, the place is inside a word. A sequence of tokens is a word's encoding if each pair of
  neighbours is the encoding of its own text: the first merge across two tokens of the word would be the
  first across them in the pair as well. All pairs left of the place stand in the left chunk's encoding,
  all right of it in the right chunk's, and the pair at the place in both.
* Normalization reaches over a place only if the character after it joins with earlier ones (a mark, or a
  vowel or final of a Hangul syllable), and special strings only if they are cut by a chunk's end: the first
  kind of place is passed over, and so is the margin that a special string spans.

Where no such pair is found the overlap is doubled, and once it would hold the whole left chunk, that chunk
is encoded anew with twice its length: at worst the text is encoded at once.

Defined cases: a null or empty text has no bytes and no tokens; repeated rows and null ids are counted each;
special strings within a text count as the tokenizer takes them by default; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal
from .words import chunks

LIMIT = 2048
#: Characters of a chunk, of the first overlap, and next to a chunk's ends where no splice is sought.
CHUNK = 1 << 15
OVERLAP = 1 << 9
MARGIN = 64
#: Bytes of text that are encoded in one call.
CALL_BYTES = 1 << 20


def load(path: str):
    """The tokenizer of a .json file; one whose splices are not proven by the above is refused."""
    import json

    from tokenizers import Tokenizer

    with open(path) as f:
        form = json.load(f)
    model = form["model"]
    proven = model["type"] == "BPE" and model.get("end_of_word_suffix") and not model.get("dropout") and not model.get("ignore_merges")
    if not proven or form.get("truncation") or form.get("padding") or "(?<" in json.dumps(form["pre_tokenizer"]):
        raise ValueError(f"{path}: a BPE tokenizer that marks the ends of words, without look-behind, dropout, truncation and padding, is needed")
    return Tokenizer.from_file(path)


class _Part:
    """The encoding of text[start:stop], offsets counted from the whole text's start."""

    def __init__(self, tokenizer, text: str, start: int, stop: int):
        encoded = tokenizer.encode(text[start:stop], add_special_tokens=False)
        self.start, self.stop = start, stop
        self.ids = np.array(encoded.ids, dtype=np.int64)
        spans = np.array(encoded.offsets, dtype=np.int64).reshape(-1, 2) + start
        self.begins, self.ends = spans[:, 0], spans[:, 1]

    def __len__(self) -> int:
        return len(self.ids)

    def begins_like(self, other: _Part, n: int) -> bool:
        """Whether the first ``n`` tokens of both are the same, so that a splice before the last of them holds for both."""
        return all(np.array_equal(a[:n], b[:n]) for a, b in ((self.ids, other.ids), (self.begins, other.begins), (self.ends, other.ends)))

    def pairs(self, low: int, high: int) -> dict[tuple[int, ...], int]:
        """Neighbouring tokens within [low, high], as (id, begin, end) twice, with the second one's index."""
        first = int(np.searchsorted(self.begins, low))
        last = int(np.searchsorted(self.ends, high, "right"))
        rows = np.stack([self.ids, self.begins, self.ends], 1)[first:last].tolist()
        return {(*a, *b): first + i + 1 for i, (a, b) in enumerate(zip(rows[:-1], rows[1:], strict=True)) if a[2] <= b[1]}


def _joins_back(c: str) -> bool:
    """Whether normalization may join the character with earlier ones."""
    return unicodedata.category(c)[0] == "M" or "\u1160" <= c <= "\u11ff" or "\ud7b0" <= c <= "\ud7ff"


def _splice(text: str, left: _Part, right: _Part, after: int) -> tuple[int, int] | None:
    """The index of one stable token in each part, both of them the first on the right of a place behind ``after``."""
    low, high = max(right.start + (MARGIN if right.start else 0), after), left.stop - MARGIN
    known = left.pairs(low, high)
    for pair, j in right.pairs(low, high).items():
        i = known.get(pair)
        if i is not None and not _joins_back(text[pair[4]]):
            return i, j
    return None


def count(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a text of any length, without encoding more than a few chunks' length at once unless no place is stable."""
    left, first, total = _Part(tokenizer, text, 0, min(chunk, len(text))), 0, 0
    while left.stop < len(text):
        # The part's tokens from ``first`` on are still to count.
        wide, found = overlap, None
        after = int(left.begins[first]) if first < len(left) else left.start
        while found is None and wide < left.stop - left.start:
            right = _Part(tokenizer, text, left.stop - wide, min(len(text), left.stop - wide + max(chunk, 2 * wide)))
            found = _splice(text, left, right, after)
            wide *= 2
        if found is None:
            longer = _Part(tokenizer, text, left.start, min(len(text), left.start + 2 * (left.stop - left.start)))
            if first and not longer.begins_like(left, first + 1):
                return len(tokenizer.encode(text, add_special_tokens=False))
            left = longer
            continue
        total += found[0] - first
        left, first = right, found[1]
    return total + len(left) - first


def token_counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more tokens than ``limit``) of each document.

    One pass without a shuffle: a row's work is its own, and a lost task is run again from its split."""

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        model = load(tokenizer)
        for batch in batches:
            for first, texts in chunks(batch.column(1), CALL_BYTES):
                whole = texts.to_pylist()
                short = [i for i, t in enumerate(whole) if len(t) <= chunk]
                n = np.zeros(len(whole), np.int64)
                if short:
                    n[short] = [len(e) for e in model.encode_batch_fast([whole[i] for i in short], add_special_tokens=False)]
                for i, t in enumerate(whole):
                    if len(t) > chunk:
                        n[i] = count(model, t, chunk, overlap)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), pc.cast(pc.binary_length(texts), pa.int64()), pa.array(n)], names=["doc_id", "n_bytes", "n_tokens"]
                )

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long"
    return docs.select("doc_id", "text").mapInArrow(frugal(run), schema).withColumn("over_limit", F.col("n_tokens") > limit)
