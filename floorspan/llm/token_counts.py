"""Token counts: batch encoding in Arrow functions that return lengths only.

Rows are gathered, over the borders of Arrow batches, until their texts hold ``batch_bytes`` bytes, and then encoded
together, so that a batch costs about as much whatever the lengths of its texts.  Texts are split into pieces at
safe boundaries, and a text that is longer than a batch goes through several batches, so that no more than a batch is
held in pieces.  A boundary is safe where normalizer and pre-tokenizer join no characters across it, so that the
lengths of the pieces add up to the length of the whole:
* where the pre-tokenizer drops white space (``drops_space`` reads that off the vocabulary file), each run of
  white space is one; the pieces are words, and a piece that a task has met is not encoded again;
* where the pre-tokenizer splits like GPT-2's (``splits_before_space`` reads that off the file), before a white-space
  character that follows another one's end, and pieces have about ``piece_bytes`` bytes;
* for any other vocabulary, such as one that may put a prefix before each text, texts stay whole.

Defined cases: null and empty texts have 0 bytes and 0 tokens; a text without a safe boundary stays whole; repeated
rows are each counted; there are no ties to settle; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from floorspan.llm._common import small, table
from floorspan.session import ship

#: A place where tokenizers that keep white space can be cut: white space after something else.
_CUT = re.compile(r"(?<=\S)(?=[ \n])")
#: Distinct pieces that a task remembers.
_MOST_KNOWN = 300_000


def pieces(text: str, most: int) -> Iterator[str]:
    """Parts of a text of about ``most`` characters, cut only at safe boundaries; they join to the text."""
    lo = 0
    while len(text) - lo > most:
        found = _CUT.search(text, lo + most)
        if found is None:
            break
        yield text[lo : found.start()]
        lo = found.start()
    yield text[lo:]


def drops_space(vocabulary: dict) -> bool:
    """Whether no token of a vocabulary file reaches over white space: its first pre-tokenizer keeps only stretches without any."""
    added = vocabulary.get("added_tokens") or []
    if any(t.get("lstrip") or t.get("rstrip") or re.search(r"\s", t["content"]) for t in added):
        return False
    first = vocabulary.get("pre_tokenizer") or {}
    while first.get("type") == "Sequence":
        first = first["pretokenizers"][0]
    if first.get("type") in ("WhitespaceSplit", "BertPreTokenizer"):
        return True
    pattern = (first.get("pattern") or {}).get("Regex")
    if first.get("type") != "Split" or first.get("behavior") != "Removed" or not first.get("invert") or pattern is None:
        return False
    negated = re.findall(r"\[\^[^\]]*\]", pattern)
    rest = re.sub(r"\[\^[^\]]*\]", "", pattern)
    return all(r"\s" in x for x in negated) and not re.search(r"[\s.^]|\\[sSWDPhHvVRX]", rest)


#: Normalizers that look at single characters or combine those that no white space parts.
_LOCAL = {"NFC", "NFD", "NFKC", "NFKD", "Lowercase", "StripAccents"}


def _parts(node: dict | None, many: str) -> list[dict]:
    """The steps of a normalizer or pre-tokenizer, sequences laid open."""
    if not node:
        return []
    return [x for y in node[many] for x in _parts(y, many)] if node.get("type") == "Sequence" else [node]


def keeps_pieces(vocabulary: dict) -> bool:
    """Whether each normalizer treats the pieces of a text as it does the whole: no prefixes, no stripping at ends, and
    replacements only of white-space runs by white space."""
    for step in _parts(vocabulary.get("normalizer"), "normalizers"):
        runs = step.get("type") == "Replace" and (step.get("pattern") or {}).get("Regex") == r"\s+" and step.get("content") == " "
        if step.get("type") not in _LOCAL and not runs:
            return False
    steps = _parts(vocabulary.get("pre_tokenizer"), "pretokenizers")
    # later steps see what the first one left
    return not any(x.get("add_prefix_space") or x.get("type") == "Metaspace" for x in steps)


def splits_before_space(vocabulary: dict) -> bool:
    """Whether pieces may be cut before white space: the first step is the byte-level split, whose tokens hold white space
    only at their beginning, or are white space."""
    steps = _parts(vocabulary.get("pre_tokenizer"), "pretokenizers")
    added = vocabulary.get("added_tokens") or []
    whole = any(t.get("lstrip") or t.get("rstrip") or re.search(r"\s", t["content"]) for t in added)
    runs = any(x.get("type") == "Replace" for x in _parts(vocabulary.get("normalizer"), "normalizers"))
    return bool(steps) and steps[0].get("type") == "ByteLevel" and steps[0].get("use_regex", True) and not whole and not runs


class Encoder:
    """Token counts of lists of pieces by the library for a vocabulary file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            self._t = Tokenizer.from_file(path)
            self._t.no_truncation()
            self._t.no_padding()
            self.lengths = lambda texts: [len(e) for e in self._t.encode_batch_fast(texts, add_special_tokens=False)]
            with open(path, encoding="utf-8") as f:
                vocabulary = json.load(f)
            self.by_words = keeps_pieces(vocabulary) and drops_space(vocabulary)
            self.can_cut = keeps_pieces(vocabulary) and splits_before_space(vocabulary)
        else:
            import sentencepiece

            self._t = sentencepiece.SentencePieceProcessor(model_file=path)
            self.lengths = lambda texts: [len(e) for e in self._t.encode(texts, num_threads=1)]
            self.can_cut = self.by_words = False  # it may add a dummy prefix to every piece

    def parts(self, text: str, batch_bytes: int, piece_bytes: int) -> Iterator[list[str]]:
        """The pieces of a text, in lists of at most about a batch."""
        if self.by_words:
            for part in pieces(text, batch_bytes):
                yield part.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        elif self.can_cut:
            for part in pieces(text, batch_bytes):
                yield list(pieces(part, piece_bytes))
        else:
            yield [text]


class Counting:
    """Lengths of rows' texts; rows leave in order, once a batch is full."""

    def __init__(self, encoder: Encoder, batch_bytes: int, piece_bytes: int):
        self.encoder, self.batch_bytes, self.piece_bytes = encoder, batch_bytes, piece_bytes
        self.totals: list[int] = []
        self._open: list[tuple[int, list[str]]] = []
        self._held = 0
        self._known: dict[str, int] = {}

    def add(self, text: str | None, n_bytes: int) -> bool:
        """Take in the next row; whether a batch has just been encoded, so that all rows so far are counted."""
        row = len(self.totals)
        self.totals.append(0)
        if not text:
            return False
        if n_bytes <= self.batch_bytes:
            for part in self.encoder.parts(text, self.batch_bytes, self.piece_bytes):
                self._open.append((row, part))
            self._held += n_bytes
        else:
            for part in self.encoder.parts(text, self.batch_bytes, self.piece_bytes):
                self._open.append((row, part))
                self._encode()
        if self._held >= self.batch_bytes:
            self._encode()
        return not self._open

    def _encode(self) -> None:
        known = self._known
        if self.encoder.by_words:
            if len(known) > _MOST_KNOWN:
                known.clear()
            new = list(set().union(*(part for _, part in self._open)).difference(known))
            known.update(zip(new, self.encoder.lengths(new), strict=True))
            for row, part in self._open:
                self.totals[row] += sum(map(known.__getitem__, part))
        else:
            lengths = iter(self.encoder.lengths([p for _, part in self._open for p in part]))
            for row, part in self._open:
                self.totals[row] += sum(next(lengths) for _ in part)
        self._open, self._held = [], 0

    def take(self) -> list[int]:
        """The lengths of all rows since the last time."""
        if self._open:
            self._encode()
        out, self.totals = self.totals, []
        return out


def count_tokens(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, batch_bytes: int = 1 << 20, piece_bytes: int = 1 << 16
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row; ``vocabulary`` is a path that every worker has."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counting = Counting(Encoder(vocabulary), batch_bytes, piece_bytes)
        ids: list[pa.Array] = []
        sizes: list[int] = []

        def out() -> pa.RecordBatch:
            n = counting.take()
            columns = [pa.concat_arrays(ids), pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())]
            ids.clear()
            sizes.clear()
            return pa.RecordBatch.from_arrays(columns, [id_col, "n_bytes", "n_tokens", "over_limit"])

        for batch in small(batches):
            at = 0
            for k, text in enumerate(batch.column(1).to_pylist()):
                sizes.append(len(text.encode("utf-8", "surrogatepass")) if text else 0)
                if counting.add(text, sizes[-1]):
                    ids.append(batch.column(0).slice(at, k + 1 - at))
                    at = k + 1
                    yield out()
            if at < batch.num_rows:
                ids.append(batch.column(0).slice(at))
        if sizes:
            yield out()

    ship(docs.sparkSession)
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
