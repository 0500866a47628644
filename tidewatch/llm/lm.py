"""Language-model scores by a weighted backoff automaton.

States are the contexts seen in training, the last ``order - 1`` tokens at most. A state has an arc
for each token that followed it there, and a failure arc to the state of the context without its
first token. Weights come from Dirichlet smoothing, which sums to one over all tokens:

    arc      log10((c(h w) + kappa * P(w | h')) / (c(h) + kappa))
    failure  log10(kappa / (c(h) + kappa)), then on from h'

with P(w) = (c(w) + 1) / (N + V + 1) at the root, where one more type stands for unknown tokens. A
text is read once from left to right, and carries its state: a token takes the arc of the state, or
the failure arcs down to a state that has one, whose weights add up; the arc leads to the next state.
The texts of a part take their steps together. A text of more than ``PIECE`` tokens is read in pieces;
each starts in the state that its predecessor ends in, as that is the longest one its last tokens spell.

The automaton of a corpus is as large as the corpus, so it is neither broadcast nor held in one
place. Counts are kept in buckets (see ``exchange``); each part of the texts sends its distinct
n-grams with their training counts once, and gets back the corpus-wide counts of just the states
and arcs that its own texts can visit. The longest n-grams are nearly as many as the words, so they come
last: an n-gram that is in two parts has its first and its last ``order - 1`` tokens in both, and those with
either in no other part are not sent, as their own part has the whole count.

Defined results: a null text is empty and scores its end token; a null doc_id has the empty string
as its text and comes back as null; repeated rows count as often as they come; an empty table gives
an empty result; a model without training texts scores every token 1; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import exchange as ex
from tidewatch.llm import kernel as kn

BEGIN, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
#: bytes of text in a part: larger parts send fewer distinct n-grams
PART_BYTES = 12 << 20
KAPPA = 100.0
#: tokens read in one go: a longer text is read in pieces, each from the state at its first place
PIECE = 2048

ASK = "bucket int, level int, part int, keys binary, counts binary"
ANSWER = "part int, level int, bucket int, counts binary, shared binary, total long, types long"


def pack_counts(x: np.ndarray) -> bytes:
    """How many counts, a byte for each, and those that do not fit into one, behind."""
    return np.int64(len(x)).tobytes() + np.minimum(x, 255).astype(np.uint8).tobytes() + x[x >= 255].astype(np.int64).tobytes()


def unpack_counts(x: bytes) -> np.ndarray:
    n = int(np.frombuffer(x, np.int64, 1)[0])
    out = np.frombuffer(x, np.uint8, n, offset=8).astype(np.int64)
    out[out == 255] = np.frombuffer(x[8 + n :], np.int64)
    return out


def pack_flags(x: np.ndarray) -> bytes:
    """A bit for each flag, and how many there are."""
    return np.int64(len(x)).tobytes() + np.packbits(x).tobytes()


def unpack_flags(x: bytes) -> np.ndarray:
    n = int(np.frombuffer(x, np.int64, 1)[0])
    return np.unpackbits(np.frombuffer(x, np.uint8, offset=8), count=n).astype(bool)


def in_training(ids: np.ndarray, folds: int, held_out: int) -> np.ndarray:
    text = (b"" if i == ex.NULL_ID else str(i).encode() for i in ids.tolist())
    return np.fromiter((zlib.crc32(t) % folds != held_out for t in text), bool, len(ids))


def token_keys(table: pa.Table, order: int, wanted: range | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Per level the keys of the n-grams that end at each place, and where rows begin; only ``wanted`` levels have keys.

    A row's first place is the state before its first token; it is no token and has no key of the
    highest level. Its last place is the end token.
    """
    wanted = range(order) if wanted is None else wanted
    hasher, is_word, lower = kn.Hasher(), kn.is_word_byte(), kn.lowered()
    levels: list[list[np.ndarray]] = [[] for _ in range(order)]
    sizes = []
    for _, data, off in kn.slices(table["text"]):
        data = lower[data]
        start, end, first = kn.find_words(data, off, is_word)
        n = np.diff(first)
        begin = np.concatenate([[0], np.cumsum(n + order)])
        stream = np.full(int(begin[-1]), BEGIN, np.uint64)
        stream[begin[1:] - 1] = END
        rows = kn.row_of(first)
        stream[np.arange(len(start)) + (order - 1) * (rows + 1) + rows] = hasher.word_hash(data, start, end)
        keep = np.ones(len(stream), bool)
        for i in range(order - 2):
            keep[begin[:-1] + i] = False
        at = np.flatnonzero(keep)
        for level in wanted:
            runs = hasher.run_hash(stream, level + 1)
            levels[level].append(runs[np.maximum(at - level, 0)])
        sizes.append(n + 2)
    size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    first = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    for level, each in enumerate(levels):
        # level by level, so that no more than one is there twice
        levels[level] = np.concatenate(each) if each else np.zeros(0, np.uint64)
        del each
    return levels, first


def level_keys(keys: list[np.ndarray], first: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of a level in order, the place of each n-gram among them (-1: none), and a place where each is.

    Takes the keys of the level out of the list.
    """
    key, keys[level] = keys[level], None
    if level < len(keys) - 1:
        return kn.distinct(key)
    use = np.ones(len(key), bool)
    use[first[:-1]] = False
    key = key[use]
    values, number, sample = kn.distinct(key)
    del key
    place = np.full(len(use), -1, np.int32)
    place[use] = number
    del number
    return values, place, np.flatnonzero(use).astype(np.int32)[sample]


def asking(part: int, level: int, values: np.ndarray, count: np.ndarray, buckets: int, first: int = 0) -> dict[str, list]:
    """Keys and counts of a level by bucket, numbered from ``first``."""
    bucket, bound = ex.by_bucket(values, buckets)
    return {
        "bucket": (bucket + first).tolist(),
        "level": [level] * len(bucket),
        "part": [part] * len(bucket),
        "keys": [kn.pack_gaps(values[a:b]) for a, b in zip(bound[:-1], bound[1:], strict=True)],
        "counts": [pack_counts(count[a:b]) for a, b in zip(bound[:-1], bound[1:], strict=True)],
    }


def asked_table(asked: list[dict[str, list]]) -> pa.Table:
    rows = {c: [x for each in asked for x in each[c]] for c in ("bucket", "level", "part", "keys", "counts")}
    return pa.table(
        {c: pa.array(rows[c], pa.int32()) for c in ("bucket", "level", "part")}
        | {c: ex.binary(rows[c]) for c in ("keys", "counts")}
    )


def own_counts(values: np.ndarray, place: np.ndarray, trained: np.ndarray) -> np.ndarray:
    """Occurrences of the n-grams of a level in the training texts of the part."""
    return np.bincount(place[trained & (place >= 0)], minlength=len(values))


def ask(order: int, buckets: list[int], folds: int, held_out: int):
    """What the texts of a part need counted but for the longest n-grams, with the counts of its own training texts."""

    def run(table: pa.Table) -> pa.Table:
        kn.give_back()
        part = table["part"][0].as_py()
        table = ex.in_order(table)
        keys, first = token_keys(table, order, range(order - 1))
        trained = np.repeat(in_training(table["doc_id"].to_numpy(), folds, held_out), np.diff(first))
        del table
        asked = []
        for level in range(order - 1):
            values, place, _ = level_keys(keys, first, level)
            count = own_counts(values, place, trained)
            asked.append(asking(part, level, values, count, buckets[level], sum(buckets[:level])))
        return asked_table(asked)

    return run


def in_other_parts(answers: pa.Table, level: int, place: np.ndarray, sample: np.ndarray) -> np.ndarray:
    """Which of the longest n-grams may be in other parts too: what they begin and end with is.

    ``place``: the number of the n-gram one token shorter that ends at each place; ``sample``: a place of each.
    """
    rows = zip(*(answers[c].to_pylist() for c in ("level", "bucket", "shared")), strict=True)
    answered = sorted((bucket, x) for at, bucket, x in rows if at == level)
    if not answered:
        return np.zeros(len(sample), bool)
    shared = np.concatenate([unpack_flags(x) for _, x in answered])
    return shared[place[sample]] & shared[place[sample - 1]]


def ask_longest(order: int, buckets: list[int], folds: int, held_out: int):
    """The longest n-grams of a part that may be in other parts too, with the counts of its own training texts."""

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        kn.give_back()
        if not len(table):
            return asked_table([])
        part = table["part"][0].as_py()
        table = ex.in_order(table)
        keys, first = token_keys(table, order, range(order - 2, order))
        trained = np.repeat(in_training(table["doc_id"].to_numpy(), folds, held_out), np.diff(first))
        del table
        place = level_keys(keys, first, order - 2)[1]
        values, own, sample = level_keys(keys, first, order - 1)
        count = own_counts(values, own, trained)
        del own, trained
        also = in_other_parts(answers, order - 2, place, sample)
        del place, sample
        return asked_table([asking(part, order - 1, values[also], count[also], buckets[-1])])

    return run


def _summed(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    each = [kn.unpack_gaps(x.as_py()) for x in table["keys"]]
    size, keys = [len(x) for x in each], np.concatenate(each)
    del each
    values, inverse, _ = kn.distinct(keys)
    total = np.zeros(len(values), np.int64)
    at = 0
    for n, x in zip(size, table["counts"], strict=True):
        # a part asks for a key once
        total[inverse[at : at + n]] += unpack_counts(x.as_py())
        at += n
    return values, total, inverse, size


def answer(table: pa.Table) -> pa.Table:
    """Corpus-wide counts, and whether another part asked too, in the order in which a part asked."""
    kn.give_back()
    values, total, inverse, size = _summed(table)
    bound = np.concatenate([[0], np.cumsum(size)])
    shared = np.bincount(inverse, minlength=len(values)) > 1
    zero = np.zeros(len(size), np.int64)
    cut = lambda f, x: ex.binary([f(x[inverse[a:b]]) for a, b in zip(bound[:-1], bound[1:], strict=True)])
    return pa.table(
        {c: table[c] for c in ("part", "level", "bucket")}
        | {"counts": cut(pack_counts, total), "shared": cut(pack_flags, shared), "total": zero, "types": zero}
    )


def totals(table: pa.Table) -> pa.Table:
    """Training tokens and types of a bucket; only the lowest level has some."""
    n = v = 0
    if table["level"][0].as_py() == 0:
        values, total, _, _ = _summed(table)
        total[values == kn.Hasher().run_hash(np.array([BEGIN]), 1)[0]] = 0
        n, v = int(total.sum()), int((total > 0).sum())
    return pa.table({"total": [n], "types": [v]})


def narrow(count: np.ndarray) -> np.ndarray:
    """In 32 bits, if they hold all."""
    return count.astype(np.int32) if count.max(initial=0) < 1 << 31 else count


class Automaton:
    """States and arcs that the texts of a part can visit; state 0 is the root, which has an arc for every token.

    ``places`` has per level the number of the n-gram that ends at each place, ``samples`` a place for each
    number, ``counts`` its occurrences in all training texts. A context of l tokens seen in training is a state,
    numbered behind those of fewer tokens; a token seen behind it is an arc.
    """

    def __init__(self, kappa: float, first: np.ndarray, places: list, samples: list, counts: list, tokens: int, types: int):
        order = len(counts)
        self.counts, self.places, self.types = counts, places, np.int64(max(1, len(counts[0])))
        #: number of the first state of l + 1 tokens
        self.offset = 1 + np.concatenate([[0], np.cumsum([len(c) for c in counts[:-1]])])
        share = (counts[0] + 1.0) / (tokens + types + 1.0)
        self.root = np.log10(share)
        self.root_next = np.where(counts[0] > 0, self.offset[0] + np.arange(len(share)), 0).astype(np.int32)
        self.fail, self.up = np.zeros(int(self.offset[-1])), np.zeros(int(self.offset[-1]), np.int32)
        before = np.zeros(len(places[0]), bool)
        before[first] = True
        # the n-gram before a row's first token ends no arc
        is_arc = [(counts[level] > 0) & ~before[samples[level]] for level in range(1, order)]
        n = np.concatenate([[0], np.cumsum([np.count_nonzero(x) for x in is_arc])])
        self.key, self.weight, self.next = np.zeros(n[-1], np.int64), np.zeros(n[-1]), np.zeros(n[-1], np.int32)
        del before
        for level in range(1, order):
            state = slice(int(self.offset[level - 1]), int(self.offset[level]))
            self.fail[state] = np.log10(kappa / (counts[level - 1] + kappa))
            if level > 1:
                self.up[state] = self.offset[level - 2] + places[level - 2][samples[level - 1]]
            here = slice(int(n[level - 1]), int(n[level]))
            arc = np.flatnonzero(is_arc[level - 1]).astype(np.int32)
            is_arc[level - 1] = None
            at = samples[level][arc]
            wanted = places[level - 1][np.maximum(at - 1, 0)].astype(np.int64)
            wanted += self.offset[level - 1]
            wanted *= self.types
            wanted += places[0][at]
            # states of a level are numbered behind those of the one below, and so are their arcs
            sort = np.argsort(wanted).astype(np.int32)
            self.key[here] = wanted[sort]
            del wanted
            arc, at = arc[sort], at[sort]
            del sort
            if level < order - 1:
                self.next[here] = self.offset[level] + arc
                share = self._share(level, samples[level], counts[level], share, kappa)
                self.weight[here] = np.log10(share[arc])
            else:
                self.next[here] = self.offset[level - 1] + places[level - 1][at]
                self.weight[here] = self._share(level, at, counts[level][arc], share, kappa)
                np.log10(self.weight[here], out=self.weight[here])
            del arc, at

    def _share(self, level: int, at: np.ndarray, count: np.ndarray, below: np.ndarray, kappa: float) -> np.ndarray:
        """P(w | h) of the n-grams of a level that end at ``at``, by the shares of those one token shorter."""
        out = below[self.places[level - 1][at]]
        out *= kappa
        out += count
        behind = self.counts[level - 1][self.places[level - 1][np.maximum(at - 1, 0)]]
        return np.divide(out, behind + kappa, out=out)

    def state_at(self, place: np.ndarray) -> np.ndarray:
        """The longest state that ends at each place."""
        out = np.zeros(len(place), np.int32)
        for level in range(len(self.counts) - 1):
            number = self.places[level][place]
            out = np.where(self.counts[level][number] > 0, self.offset[level] + number, out).astype(np.int32)
        return out

    def step(self, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and log-probabilities of one more token each: failure arcs down to a state that has its arc."""
        score, after = np.zeros(len(state)), np.zeros(len(state), np.int32)
        left = np.arange(len(state))
        while len(left):
            here, word = state[left], token[left]
            wanted = here.astype(np.int64) * self.types + word
            at = np.minimum(np.searchsorted(self.key, wanted), max(len(self.key) - 1, 0))
            hit = (here > 0) & (self.key[at] == wanted) if len(self.key) else np.zeros(len(left), bool)
            score[left[hit]] += self.weight[at[hit]]
            after[left[hit]] = self.next[at[hit]]
            root = here == 0
            score[left[root]] += self.root[word[root]]
            after[left[root]] = self.root_next[word[root]]
            on = ~hit & ~root
            left = left[on]
            score[left] += self.fail[here[on]]
            state = state.copy() if len(left) else state
            state[left] = self.up[here[on]]
        return after, score

    def read(self, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Scores of the pieces of ``size`` tokens behind the places ``begin``, each read from left to right.

        All pieces take a step at a time; a piece carries its state and the sum of its logarithms.
        """
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        state, total = self.state_at(begin), np.zeros(len(begin))
        for t in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size, -t, side="left"))
            state, score = self.step(state[:live], self.places[0][begin[:live] + t + 1])
            total[:live] += score
        out = np.zeros(len(total))
        out[order] = total
        return out


def pieces(first: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows cut into pieces of at most ``most`` tokens: the row, the place before, and the tokens of each."""
    tokens = np.diff(first) - 1
    n = -(-tokens // most)
    row = np.repeat(np.arange(len(tokens)), n)
    no = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return row, first[:-1][row] + no * most, np.minimum(tokens[row] - no * most, most)


def walk(order: int, kappa: float, folds: int, held_out: int, piece: int):
    """Read the texts of a part through the automaton."""

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        kn.give_back()
        table = ex.in_order(table)
        ids = table["doc_id"].to_numpy()
        keys, first = token_keys(table, order)
        del table
        by_level: list[list] = [[] for _ in range(order)]
        n_all = v_all = 0
        for level, bucket, packed, n, v in zip(
            *(answers[c].to_pylist() for c in ("level", "bucket", "counts", "total", "types")), strict=True
        ):
            if level < 0:
                n_all, v_all = n, v
            else:
                by_level[level].append((bucket, packed))
        places, samples, counts = [], [], []
        trained = np.repeat(in_training(ids, folds, held_out), np.diff(first))
        for level in range(order):
            values, place, sample = level_keys(keys, first, level)
            answered = [unpack_counts(x) for _, x in sorted(by_level[level])]
            found = np.concatenate(answered) if answered else np.zeros(0, np.int64)
            if level == order - 1:
                count = own_counts(values, place, trained)
                count[in_other_parts(answers, level - 1, places[level - 1], sample)] = found
                found = count
                del count
            places.append(place)
            samples.append(sample)
            counts.append(narrow(found))
            del values, place, sample, found, answered
        del keys, trained, answers, by_level
        kn.give_back()
        n_tokens = np.diff(first) - 1
        machine = Automaton(kappa, first[:-1], places, samples, counts, n_all, v_all)
        # only the arcs of the longest n-grams are looked at from here on
        places[-1] = counts[-1] = None
        samples.clear()
        kn.give_back()
        # the state at a place follows from the tokens before it, so a long text is read in pieces
        row, begin, size = pieces(first, piece)
        token = np.ones(int(first[-1]), bool)
        token[first[:-1]] = False
        word = places[0][token]
        add = lambda x: np.add.reduceat(x, np.cumsum(n_tokens) - n_tokens) if len(n_tokens) else np.zeros(0)
        return pa.table(
            {
                "doc_id": ex.id_column(ids),
                "held_out": ~in_training(ids, folds, held_out),
                "n_tokens": n_tokens,
                "n_known": add((counts[0][word] > 0).astype(np.int64)).astype(np.int64),
                "train_tokens": np.full(len(ids), n_all, np.int64),
                "base_score": add(machine.root[word]),
                "score": np.bincount(row, machine.read(begin, size), len(ids)).astype(float),
            }
        )

    return run


def score_texts(
    docs: DataFrame,
    order: int = 2,
    kappa: float = KAPPA,
    folds: int = 7,
    held_out: int = 2,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Scores of all texts under a model of those with crc32(doc_id) mod ``folds`` not ``held_out``."""
    if order < 2:
        raise ValueError("an automaton has states from order 2 on")
    total = ex.text_bytes(docs, text)
    parts = max(64, -(-total // PART_BYTES))
    tokens = total / 6
    buckets = [ex.bucket_count(tokens * 0.15)] + [ex.bucket_count(tokens * 0.75)] * (order - 1)
    # a part or bucket is a partition: dealt by hash, several would be sorted and held in one task
    by_part = lambda df: df.repartitionById(parts, "part").groupBy("part")
    by_bucket = lambda df, n: df.repartitionById(n, "bucket").groupBy("bucket")
    grouped = by_part(ex.in_parts(docs, parts, doc_id, text))
    asked = by_bucket(grouped.applyInArrow(ask(order, buckets, folds, held_out), ASK), sum(buckets[:-1]))
    answers = asked.applyInArrow(answer, ANSWER)
    shared = answers.where(F.col("level") == order - 2).select("part", "level", "bucket", "shared")
    longest = grouped.cogroup(by_part(shared)).applyInArrow(ask_longest(order, buckets, folds, held_out), ASK)
    longest = by_bucket(longest, buckets[-1]).applyInArrow(answer, ANSWER).withColumn("shared", F.lit(None).cast("binary"))
    sums = asked.applyInArrow(totals, "total long, types long").agg(
        F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.coalesce(F.sum("types"), F.lit(0)).alias("types")
    )
    everyone = sums.select(
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"),
        F.lit(-1).alias("level"),
        F.lit(-1).alias("bucket"),
        F.lit(None).cast("binary").alias("counts"),
        F.lit(None).cast("binary").alias("shared"),
        "total",
        "types",
    )
    kept = F.when(F.col("level") == order - 2, F.col("shared")).alias("shared")
    answers = answers.select("part", "level", "bucket", "counts", kept, "total", "types")
    answers = answers.unionByName(longest).unionByName(everyone)
    return grouped.cogroup(by_part(answers)).applyInArrow(
        walk(order, kappa, folds, held_out, PIECE),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
