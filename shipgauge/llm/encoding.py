"""Token ids of batches of texts inside a task.

The tokenizer files in use split a text at white space before anything else
happens, so the ids of a text are the ids of its words one after the other. A
batch is therefore cut into words by Arrow, only words that this worker has not
met yet go through the tokenizer library, and the rest is a lookup. Texts with
white space for which the cut is not exact go through the library whole, and so
does everything under a tokenizer whose splitting rule is not known here.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Words kept per worker and tokenizer; beyond either bound the memo starts anew.
MEMO_WORDS = 2_000_000
MEMO_BYTES = 64 << 20
WORDS_PER_CALL = 4096
# Text is worked through in slices of about this many bytes.
SLICE_BYTES = 32 << 20

# White space other than a single space or line feed between visible characters.
_NOT_SINGLE = "[\\x00\\t\\x0b\\f\\r\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]|[ \\n][ \\n]"
# Characters that Arrow takes for white space and tokenizers do not.
_SEPARATORS = "[\\x1c-\\x1f]"
BYTE_PATTERN_KEPT, WORDS_ONLY = "kept", "dropped"


def split_rule(spec: dict) -> str | None:
    """How a tokenizer file treats white space: kept with the word, dropped, or not known."""
    pre = spec.get("pre_tokenizer") or {}
    if any(t.get("lstrip") or t.get("rstrip") or t.get("normalized") or t.get("single_word") or any(c.isspace() for c in t["content"])
           for t in spec.get("added_tokens") or []):
        return None
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer"):
        return BYTE_PATTERN_KEPT
    steps = pre.get("pretokenizers") or []
    kinds = [s.get("type") for s in (spec.get("normalizer") or {}).get("normalizers", [])]
    words = steps and steps[0].get("type") == "Split" and steps[0].get("invert") and steps[0].get("behavior") == "Removed"
    if words and "[^\\s" in steps[0]["pattern"].get("Regex", "") and kinds == ["NFC", "Replace", "Lowercase"]:
        return WORDS_ONLY
    return None


class Encoder:
    """Ids of texts under one tokenizer file (.json or .model)."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            piece = sentencepiece.SentencePieceProcessor(model_file=path)
            self._whole = lambda texts: piece.encode(texts, num_threads=1)
            self.rule = None
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self._tokenizer = Tokenizer.from_file(path)
            self._tokenizer.no_truncation()
            self._tokenizer.no_padding()
            if hasattr(self._tokenizer.model, "_resize_cache"):
                self._tokenizer.model._resize_cache(0)  # its words come once each; see MEMO_WORDS
            self._whole = lambda texts: [e.ids for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            with open(path, encoding="utf-8") as f:
                self.rule = split_rule(json.load(f))
        self._forget()

    def _forget(self) -> None:
        self._words = pa.array([], pa.large_string())
        self._lengths = np.zeros(0, np.int64)
        self._ids = np.zeros(0, np.uint32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after the other, and where each text begins in them (one more than texts)."""
        counts, lists = self._by_words(texts, True)
        return lists, np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)

    def count(self, texts: pa.Array) -> np.ndarray:
        return self._by_words(texts, False)[0]

    def _by_words(self, texts: pa.Array, want_ids: bool) -> tuple[np.ndarray, np.ndarray | None]:
        if not len(texts):
            return np.zeros(0, np.int64), np.zeros(0, np.uint32)
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if self.rule is None:
            return self._through_library(texts, want_ids)
        odd = pc.match_substring_regex(texts, _NOT_SINGLE if self.rule == BYTE_PATTERN_KEPT else _SEPARATORS)
        odd = odd.to_numpy(zero_copy_only=False)
        if not odd.any():
            return self._memoised(texts, want_ids)
        plain, apart = self._memoised(texts.filter(pa.array(~odd)), want_ids), self._through_library(texts.filter(pa.array(odd)), want_ids)
        counts = np.empty(len(odd), np.int64)
        counts[~odd], counts[odd] = plain[0], apart[0]
        if not want_ids:
            return counts, None
        starts = np.concatenate([[0], np.cumsum(counts)])
        ids = np.empty(starts[-1], np.uint32)
        mask = np.repeat(odd, counts)
        ids[~mask], ids[mask] = plain[1], apart[1]
        return counts, ids

    def _through_library(self, texts: pa.Array, want_ids: bool) -> tuple[np.ndarray, np.ndarray | None]:
        counts, ids = [], []
        for at in range(0, len(texts), 64):
            for x in self._whole(texts[at:at + 64].to_pylist()):
                counts.append(len(x))
                if want_ids:
                    ids.append(np.array(x, np.uint32))
        return np.array(counts, np.int64), np.concatenate(ids) if ids else np.zeros(0, np.uint32)

    def _cut(self, texts: pa.Array) -> pa.Array:
        if self.rule == WORDS_ONLY:
            return pc.utf8_split_whitespace(texts)
        # A space goes with the word after it, a line feed stands alone.
        marked = pc.replace_substring(pc.replace_substring(texts, " ", "\x00 "), "\n", "\x00\n\x00")
        return pc.split_pattern(marked, "\x00")

    def _memoised(self, texts: pa.Array, want_ids: bool) -> tuple[np.ndarray, np.ndarray | None]:
        words = self._cut(texts)
        bounds = words.offsets.to_numpy()
        coded = words.flatten().dictionary_encode()
        at = self._places(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
        lengths = self._lengths[at]
        sums = np.concatenate([[0], np.cumsum(lengths)])
        counts = np.diff(sums[bounds - bounds[0]])
        if not want_ids:
            return counts, None
        # An id's place in the memo: its place here, moved by as much as its word is.
        starts = np.cumsum(self._lengths) - self._lengths
        places = np.repeat(starts[at] - sums[:-1], lengths)
        places += np.arange(len(places))
        return counts, self._ids[places]

    def _places(self, words: pa.Array) -> np.ndarray:
        """Where the memo holds each of these distinct words; new ones are encoded first."""
        found = pc.index_in(words, value_set=self._words)
        new = words.filter(pc.is_null(found))
        if not len(new):
            return found.to_numpy(zero_copy_only=False).astype(np.int64)
        if len(self._words) + len(new) > MEMO_WORDS or self._words.nbytes + new.nbytes > MEMO_BYTES:
            self._forget()
            found, new = pa.nulls(len(words), pa.int32()), words
        lengths, ids = [], []
        for k in range(0, len(new), WORDS_PER_CALL):
            some = self._whole(new[k:k + WORDS_PER_CALL].to_numpy(zero_copy_only=False).tolist())
            lengths.append(np.fromiter(map(len, some), np.int64, len(some)))
            ids.append(np.fromiter(chain.from_iterable(some), np.uint32))
        at = found.to_numpy(zero_copy_only=False).astype(np.float64)
        at[np.isnan(at)] = len(self._words) + np.arange(len(new))
        self._words = pa.concat_arrays([self._words, new])
        self._lengths = np.concatenate([self._lengths, *lengths])
        self._ids = np.concatenate([self._ids, *ids])
        return at.astype(np.int64)


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One per worker process; Spark keeps workers, so the memo serves task after task."""
    return Encoder(path)


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES):
    """Parts of a batch of about ``size`` bytes of text, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(sizes) - sizes) // size
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(sizes)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)
