"""Token counts (operator 2): batch encoding in Arrow functions.

Only lengths (here) or lengths and checksums (the packer) leave the Python
workers. Incoming batches are re-cut so that each encoder call sees about the
same number of bytes, and texts longer than ``LONG_CHARS`` are encoded in
pieces cut at *safe boundaries*: before a single space that stands between a
non-space character and an ASCII letter. The byte-level pre-tokeniser starts a new word
exactly there, so the pieces' ids joined are the ids of the whole text.

Encoders
    ``.model`` files are read by sentencepiece. ``.json`` files describe the
    ``tokenizers`` library's result. Where such a file is a plain byte-level
    BPE whose merge order is its id order (checked when it is loaded), the
    same ids come from tiktoken's core over the file's own vocabulary, several
    times faster; every other file goes through ``tokenizers`` itself.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from blockwise.llm.frames import table

#: Texts above this many characters are encoded in pieces.
LONG_CHARS = 1 << 16
#: Bytes of text given to the encoder at once.
BATCH_BYTES = 1 << 20
_SAFE = re.compile(r"(?<=[^\s]) (?=[A-Za-z])")
_GPT2 = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def pieces(text: str, long_chars: int = LONG_CHARS) -> list[str]:
    """Cuts a long text at safe boundaries; where there is none the piece grows until there is."""
    if len(text) <= long_chars:
        return [text]
    out, at = [], 0
    while len(text) - at > long_chars:
        m = _SAFE.search(text, at + long_chars)
        if not m:
            break
        out.append(text[at : m.start()])
        at = m.start()
    out.append(text[at:])
    return out


def _byte_of() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _plain_byte_bpe(spec: dict) -> tuple[dict[bytes, int], dict[str, int]] | None:
    """(ranks, specials) if ids of this file follow from merge ranks alone, else None."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    added = spec.get("added_tokens") or []
    plain = (
        model.get("type") == "BPE" and not model.get("dropout") and not spec.get("normalizer") and not model.get("ignore_merges")
        and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix") and not model.get("byte_fallback")
        and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        and not any(a.get(k) for a in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
    )
    if not plain:
        return None
    byte_of = _byte_of()
    specials = {a["content"]: a["id"] for a in added}
    ids = []
    for merge in model["merges"]:
        left, right = merge.split(" ") if isinstance(merge, str) else merge
        ids.append(model["vocab"].get(left + right, -1))
    if any(b <= a for a, b in zip(ids, ids[1:], strict=False)) or -1 in ids:
        return None
    ranks = {bytes(byte_of[c] for c in t): i for t, i in model["vocab"].items() if t not in specials}
    single = [ranks.get(bytes([b]), -1) for b in range(256)]
    if -1 in single or (ids and max(single) > ids[0]) or len(ranks) != 256 + len(ids):
        return None
    return ranks, specials


class Encoder:
    """``ids(texts)``: the token ids of each text, without begin, end or added special tokens."""

    def __init__(self, path: str):
        self.path = path
        self._core = self._hf = self._sp = None
        if path.endswith(".model"):
            import sentencepiece

            self._sp = sentencepiece.SentencePieceProcessor(model_file=path)
            return
        with open(path, encoding="utf-8") as f:
            plain = _plain_byte_bpe(json.load(f))
        if plain:
            import tiktoken

            ranks, specials = plain
            self._specials = specials
            self._core = tiktoken.Encoding("file", pat_str=_GPT2, mergeable_ranks=ranks, special_tokens=specials)
        else:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            self._hf = Tokenizer.from_file(path)
            self._hf.no_truncation()
            self._hf.no_padding()

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        if self._core is not None:
            enc, out = self._core, []
            for t in texts:
                if len(t) <= LONG_CHARS:
                    out.append(enc.encode_to_numpy(t, allowed_special="all"))
                else:
                    out.append(np.concatenate([enc.encode_to_numpy(p, allowed_special="all") for p in pieces(t)]))
            return out
        if self._sp is not None:
            return [np.asarray(x, dtype=np.uint32) for x in self._sp.encode(texts, num_threads=1)]
        return [np.asarray(e.ids, dtype=np.uint32) for e in self._hf.encode_batch(texts, add_special_tokens=False)]


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder per Python worker and file."""
    return Encoder(path)


def byte_balanced(texts: pa.Array, most: int = BATCH_BYTES) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) in runs of about ``most`` bytes; nulls are empty texts."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0))
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < len(texts):
        base = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield at, [t or "" for t in texts.slice(at, to - at).to_pylist()]
        at = to


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_tokens, over_limit.

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows and null ids are kept as
    they are, an empty table gives an empty result, other columns are not read.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            texts = b.column(1)
            n_bytes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).cast(pa.int64())
            n = np.zeros(len(texts), dtype=np.int64)
            for at, part in byte_balanced(texts):
                n[at : at + len(part)] = [len(x) for x in enc.ids(part)]
            yield pa.RecordBatch.from_arrays([b.column(0), n_bytes, pa.array(n), pa.array(n > limit)], names=[b.schema.names[0], "n_bytes", "n_tokens", "over_limit"])

    slim = docs.select(docs[id_col], docs[text_col])
    kind = dict(slim.dtypes)[id_col]
    return slim.mapInArrow(count, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), default_tokenizer())
