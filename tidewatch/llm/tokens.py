"""Token counts by rank-synchronous array merging.

A text falls into *chunks* at ASCII white space; the tokenizer drops white space, so a text has as
many tokens as its chunks. New chunks of a batch go through the library's own normalizer and
pre-tokenizer, and the pre-tokens become ragged numpy arrays of symbols. All sequences are merged at
once: in each round every sequence applies its lowest-rank pair at all its places, ranks are looked
up again only beside what was merged, and finished sequences leave. What survives is counted. Chunks
already counted in the task are remembered, up to a bound.

The library is the judge of what a text has: special strings are found first, each one token.

Defined results: a null text is empty (0 bytes, 0 tokens); texts are taken whole, and a text without
white space is one chunk; repeated rows are counted alike; null ids are passed through; other columns
are ignored by ``count_tokens``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import kernel as kn

#: chunks remembered by a task before it starts anew
REMEMBER = 400_000
NONE = np.iinfo(np.int32).max


class Merges:
    """The merge table of a byte-pair vocabulary as sorted arrays."""

    def __init__(self, spec: dict):
        model = spec["model"]
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.plain = {c: i for c, i in vocab.items() if len(c) == 1}
        self.last = {c: vocab[c + suffix] for c in self.plain if c + suffix in vocab}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.rank = order.astype(np.int32)
        self.result = np.array([vocab[a + b] for a, b in pairs], np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where it does not merge."""
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], NONE)

    def symbols(self, pretokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all pre-tokens in a row, and where each begins."""
        flat: list[int] = []
        size = []
        for t in pretokens:
            ids = [self.plain[c] for c in t[:-1]]
            ids.append(self.last[t[-1]])
            flat += ids
            size.append(len(ids))
        return np.array(flat, np.int64), np.concatenate([[0], np.cumsum(size)]).astype(np.int64)

    def survivors(self, pretokens: list[str]) -> np.ndarray:
        """How many symbols each pre-token (none is empty) is left with."""
        symbol, first = self.symbols(pretokens)
        count = np.zeros(len(pretokens), np.int64)
        sequence = np.repeat(np.arange(len(pretokens)), np.diff(first))
        rank = np.full(len(symbol), NONE, np.int32)
        inner = np.flatnonzero(sequence[1:] == sequence[:-1])
        rank[inner] = self.ranks(symbol[inner], symbol[inner + 1])
        while len(symbol):
            begin = np.flatnonzero(np.diff(sequence, prepend=-1))
            size = np.diff(np.append(begin, len(symbol)))
            lowest = np.minimum.reduceat(rank, begin)
            done = lowest == NONE
            if done.any():
                count[sequence[begin[done]]] = size[done]
                stay = np.repeat(~done, size)
                symbol, sequence, rank = symbol[stay], sequence[stay], rank[stay]
                size, lowest = size[~done], lowest[~done]
                if not len(symbol):
                    break
            hit = np.flatnonzero(rank == np.repeat(lowest, size))
            # places in a row overlap: of each stretch every second one merges
            head = np.diff(hit, prepend=-2) != 1
            stretch = np.flatnonzero(head)[np.cumsum(head) - 1]
            hit = hit[(np.arange(len(hit)) - stretch) % 2 == 0]
            symbol[hit] = self.result[rank[hit]]
            stay = np.ones(len(symbol), bool)
            stay[hit + 1] = False
            to = np.cumsum(stay) - 1
            symbol, sequence, rank = symbol[stay], sequence[stay], rank[stay]
            again = np.unique(np.concatenate([to[hit], np.maximum(to[hit] - 1, 0)]))
            rank[again] = NONE
            again = again[again + 1 < len(symbol)]
            again = again[sequence[again] == sequence[again + 1]]
            rank[again] = self.ranks(symbol[again], symbol[again + 1])
        return count


class ChunkCounter:
    """Token counts of chunks of text."""

    def __init__(self, spec_text: str):
        from tokenizers import Tokenizer

        spec = json.loads(spec_text)
        if spec["model"]["type"] != "BPE":
            raise ValueError("the merge table is that of a byte-pair vocabulary")
        library = Tokenizer.from_str(spec_text)
        self.normal, self.before = library.normalizer, library.pre_tokenizer
        self.merges = Merges(spec)
        special = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

    def pretokens(self, chunk: str) -> tuple[int, list[str]]:
        """Special strings in a chunk, and the pre-tokens of what is between them."""
        parts = self.special.split(chunk) if self.special and "<" in chunk else [chunk]
        found: list[str] = []
        for part in parts[::2]:
            if part:
                text = self.normal.normalize_str(part) if self.normal else part
                found += [t for t, _ in self.before.pre_tokenize_str(text) if t] if text else []
        return len(parts) // 2, found

    def count(self, chunks: list[bytes]) -> list[int]:
        special, flat, owner = np.zeros(len(chunks), np.int64), [], []
        for i, chunk in enumerate(chunks):
            special[i], found = self.pretokens(chunk.decode())
            flat += found
            owner += [i] * len(found)
        if flat:
            different = {t: i for i, t in enumerate(dict.fromkeys(flat))}
            left = self.merges.survivors(list(different))
            np.add.at(special, owner, left[[different[t] for t in flat]])
        return special.tolist()


def counted(spec_text: str, remember: int):
    """Arrow batches of (key, text) to (key, n_bytes, n_tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, known = ChunkCounter(spec_text), {}
        for batch in batches:
            for row, data, off in kn.slices(batch["text"]):
                raw, bound = data.tobytes(), off.tolist()
                chunks = [raw[a:b].split() for a, b in zip(bound[:-1], bound[1:], strict=True)]
                if len(known) > remember:
                    known = {}
                new = list(set().union(*chunks) - known.keys())
                for at in range(0, len(new), 1 << 15):
                    some = new[at : at + (1 << 15)]
                    known.update(zip(some, counter.count(some), strict=True))
                n = [sum(map(known.__getitem__, x)) for x in chunks]
                yield pa.RecordBatch.from_pydict(
                    {
                        "key": batch["key"].slice(row, len(n)),
                        "n_bytes": pa.array(np.diff(off), pa.int64()),
                        "n_tokens": pa.array(n, pa.int64()),
                    }
                )

    return run


def count_tokens(
    docs: DataFrame, tokenizer: str, limit: int = 2048, doc_id: str = "doc_id", text: str = "text", remember: int = REMEMBER
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row per input row.

    ``tokenizer`` is the path of a tokenizers JSON file with a byte-pair model; it is read by the
    driver and travels with the job, some MB whatever the input.
    """
    with open(tokenizer, encoding="utf-8") as file:
        spec = file.read()
    source = docs.select(F.col(doc_id).alias("key"), F.col(text).alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    out = source.mapInArrow(counted(spec, remember), f"key {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("key").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
