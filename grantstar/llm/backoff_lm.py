"""Language-model scoring with a weighted backoff automaton.

All words of the training corpus are counted, and its n-grams of two and three words; those that occur twice
are kept, at every size. Counts are smoothed by absolute discounting. Histories that have kept followers are the states
of an automaton: an arc carries the log-probability of a word and leads to the longest end of what was
read that is a state again; a state without an arc for a word passes it on, at the weight of what its discount sets
free, along its failure arc to the state without the oldest word. A text is scored by one walk from left to right
that carries the state. All words that training never saw are one event, which gets what the discount of single words
sets free.

The automaton of a corpus never is in one place. Texts are packed in blocks of about BLOCK_TOKENS tokens, and a block needs
those states and arcs only that its own texts can meet. It asks for them in two rounds: first for its words and for the
followers of each, then for the followers of its kept pairs of words. A history goes with its followers to a bucket,
where the counts of all blocks are added up; the bucket answers each block in the
order of its question, with the count and the sums over all kept followers, and numbers the kept pairs, which
from then on go by their numbers. A trigram is asked for only if
both its pairs are kept, as it cannot occur twice otherwise. A key goes once from each block, so a hot word or history
is as short as any other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grantstar.llm.common import stored

DISCOUNT = 0.75
#: n-grams of two and three words are kept from this count on, at every size of the corpus.
LEAST_COUNT = 2
#: Tokens of a block of texts. A task holds one block and, with it, the arcs its texts can meet.
BLOCK_TOKENS = 1 << 19
#: Tokens of the corpus for each bucket of histories. A task holds what all blocks ask of one bucket.
BUCKET_TOKENS = 1 << 20
#: Texts of a block that are walked side by side, at least; the few longest go on one by one.
SIDE_BY_SIDE = 24

#: Hash of the end of a text. It is the least, so the end is word 0 of every block.
TEXT_END = 0
#: Words that follow the same word are told apart by so many bits of their hash.
_FOLLOWER = np.uint64((1 << 40) - 1)


def held_out(doc_id) -> F.Column:
    """True for documents the model does not learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(False))


def _tokens(text: str | None) -> list[bytes]:
    """Words, A-Z in lower case, parted by ASCII white space."""
    return (text or "").encode("utf-8", "replace").lower().split()


def _pack(numbers: np.ndarray) -> bytes:
    """Whole numbers, equal bytes of all side by side, compressed."""
    import pyarrow as pa

    raw = np.ascontiguousarray(numbers, "<u8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(data: bytes) -> np.ndarray:
    import pyarrow as pa

    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").reshape(-1)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of pairs of hashes."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    for k in (0xD6E8FEB86659FD93, 0xCF1BBCDCB7A56463):
        x = (x ^ x >> np.uint64(32)) * np.uint64(k)
    return x ^ x >> np.uint64(32)


def blocks(docs: DataFrame) -> DataFrame:
    """One row for each block of texts: its number, doc_ids, number of distinct words, and packed: which texts are training, the
    tokens of each, hashes of the distinct words in order, place of each token among them; totals of the
    training texts."""
    schema = T.StructType(
        [
            T.StructField("block", T.LongType(), False),
            T.StructField("doc_ids", T.ArrayType(docs.schema["doc_id"].dataType), False),
            T.StructField("size", T.LongType(), False),
            *(T.StructField(c, T.BinaryType(), False) for c in ("learnt", "lengths", "words", "tokens")),
            T.StructField("train_texts", T.LongType(), False),
            T.StructField("train_tokens", T.LongType(), False),
        ]
    )
    target = BLOCK_TOKENS

    def run(batches) -> Iterator:
        import pyarrow as pa
        import xxhash
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, digest = to_arrow_schema(schema), xxhash.xxh3_64_intdigest
        number = TaskContext.get().partitionId() << 32
        ids, learnt, lengths, tokens, places = [], [], [], [], {b"": 0}

        def out():
            train, sizes = np.array(learnt, np.uint64), np.array(lengths, np.uint64)
            hashes = np.array([TEXT_END, *map(digest, list(places)[1:])], np.uint64)
            words, rank = np.unique(hashes, return_inverse=True)
            row = number, ids, len(words), _pack(train), _pack(sizes), _pack(words), _pack(rank[np.array(tokens, np.int64)])
            row += int(train.sum()), int((train * sizes).sum())
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, arrow)], schema=arrow)

        for batch in batches:
            for at in range(batch.num_rows):
                doc_id, train, text = (c[at].as_py() for c in batch.columns)
                words = _tokens(text)
                tokens.extend([places.setdefault(w, len(places)) for w in words])
                tokens.append(0)
                for column, value in zip((ids, learnt, lengths), (doc_id, train, len(words) + 1)):
                    column.append(value)
                if len(tokens) >= target:
                    yield out()
                    number += 1
                    ids, learnt, lengths, tokens, places = [], [], [], [], {b"": 0}
        if ids:
            yield out()

    train = (~held_out(F.col("doc_id"))).alias("learnt")
    return docs.select("doc_id", train, "text").mapInArrow(run, schema)


@dataclass
class Followers:
    """Histories with what follows them. ``heads`` ascend; the first ``degree[0]`` of ``tails``
    follow the first head, and so on. ``n`` and ``m`` count heads and their followers in training texts."""

    heads: np.ndarray
    n: np.ndarray
    degree: np.ndarray
    tails: np.ndarray
    m: np.ndarray


@dataclass
class Answer:
    """For each head of a question its count, the sum of the counts of all kept followers, and their number; for each tail
    the count if it is kept, else 0, and a number if it is kept."""

    n: np.ndarray
    taken: np.ndarray
    followers: np.ndarray
    m: np.ndarray
    numbers: np.ndarray


class Block:
    """The texts of a block as numbers: words by rank of their hash, and the distinct pairs of words that follow each other,
    by rank of the first, then the second. ``pair`` is the pair that ends at each token, -1 at the head of a text."""

    def __init__(self, row: dict):
        self.lengths, self.tokens = (_unpack(row[c]).astype(np.int64) for c in ("lengths", "tokens"))
        self.learnt = np.repeat(_unpack(row["learnt"]).astype(bool), self.lengths)
        self.size = row["size"]
        first = np.zeros(len(self.tokens), bool)
        first[np.cumsum(self.lengths) - self.lengths] = True
        at = np.flatnonzero(~first)
        self.codes, pair = np.unique(self.tokens[at - 1] * self.size + self.tokens[at], return_inverse=True)
        self.pair = np.full(len(self.tokens), -1, np.int32)
        self.pair[at] = pair

    def words(self, hashes: np.ndarray) -> Followers:
        """The question of the first round: words, and the words that follow them, by their hashes."""
        n = np.bincount(self.tokens[self.learnt], minlength=self.size)
        m = np.bincount(self.pair[self.learnt & (self.pair >= 0)], minlength=len(self.codes))
        degree = np.bincount(self.codes // self.size, minlength=self.size)
        return Followers(hashes, n, degree, hashes[self.codes % self.size] & _FOLLOWER, m)

    def pairs(self, numbers: np.ndarray) -> tuple[Followers, np.ndarray, np.ndarray, np.ndarray]:
        """The question of the second round: kept pairs, and the kept pairs that follow them a word later. ``numbers`` are
        those of the kept pairs, -1 for others. Also the pair of each head, the first and last pair of each
        tail as columns, and the tail that ends at each token, -1 where there is none.

        Heads are all kept pairs that a word follows: what a pair hands on counts also where no triple of it is here.
        """
        at = np.flatnonzero(self.pair >= 0)
        before, last = self.pair[at - 1].astype(np.int64), self.pair[at].astype(np.int64)
        at_head = (before >= 0) & (numbers[before] >= 0)
        heads = np.unique(before[at_head])
        heads = heads[np.argsort(numbers[heads], kind="stable")]
        rank = np.zeros(len(self.codes), np.int64)
        rank[heads] = np.arange(len(heads))
        whole = at_head & (numbers[last] >= 0)
        at = at[whole]
        codes, of = np.unique(rank[before[whole]] * len(self.codes) + last[whole], return_inverse=True)
        head, last = np.divmod(codes, max(1, len(self.codes)))
        m = np.bincount(of[self.learnt[at]], minlength=len(codes))
        degree = np.bincount(head, minlength=len(heads))
        none = np.zeros(len(heads), np.int64)
        asked = Followers(numbers[heads].astype(np.uint64), none, degree, numbers[last].astype(np.uint64), m)
        triple = np.full(len(self.tokens), -1, np.int32)
        triple[at] = of
        return asked, heads, np.stack([heads[head] if len(heads) else head, last]), triple


def _rows(batches) -> Iterator[dict]:
    for batch in batches:
        for at in range(batch.num_rows):
            yield batch.slice(at, 1).to_pylist()[0]


def add_up(questions: list[Followers]) -> list[Answer]:
    """What a bucket answers to each question. Kept tails are numbered from 0 within the bucket."""
    each, head = np.unique(np.concatenate([q.heads for q in questions]), return_inverse=True)
    n = np.bincount(head, np.concatenate([q.n for q in questions]), len(each)).astype(np.int64)
    of = np.repeat(head, np.concatenate([q.degree for q in questions]))
    keys = _mix(each[of], np.concatenate([q.tails for q in questions]))
    _, first, tail = np.unique(keys, return_index=True, return_inverse=True)
    m = np.bincount(tail, np.concatenate([q.m for q in questions]), len(first)).astype(np.int64)
    m[m < LEAST_COUNT] = 0
    taken = np.bincount(of[first], m, len(each)).astype(np.int64)
    followers = np.bincount(of[first], m > 0, len(each)).astype(np.int64)
    numbers = np.where(m > 0, np.cumsum(m > 0) - 1, -1)
    ends = np.cumsum([len(q.heads) for q in questions])[:-1]
    tail_ends = np.cumsum([len(q.tails) for q in questions])[:-1]
    of_heads = [np.split(v[head], ends) for v in (n, taken, followers)]
    of_tails = [np.split(v[tail], tail_ends) for v in (m, numbers)]
    return [Answer(*parts) for parts in zip(*of_heads, *of_tails)]


_ASKED = ("heads", "n", "degree", "tails", "m")


def _exchange(
    rows: DataFrame,
    ask: Callable[[dict], Followers],
    bucket_of: Callable[[np.ndarray], np.ndarray],
    name: str,
    numbered: bool = False,
) -> DataFrame:
    """block and ``name`` (array of bucket, heads, tails, numbers: the answers in the order of the question), and
    ``{name}_kinds``, which added up over all blocks is the number of distinct heads in training."""

    def put(batches) -> Iterator:
        import pyarrow as pa

        kinds = [pa.int32(), pa.int64(), *[pa.binary()] * len(_ASKED)]
        for row in _rows(batches):
            asked = ask(row)
            bucket = bucket_of(asked.heads)
            own = np.unique(bucket)
            ends = np.append(np.searchsorted(bucket, own), len(bucket))
            tails = np.append(0, np.cumsum(asked.degree))[ends]
            columns = [own, np.full(len(own), row["block"]), *([] for _ in _ASKED)]
            for a, b, x, y in zip(ends, ends[1:], tails, tails[1:]):
                steps = np.diff(asked.heads[a:b], prepend=np.uint64(0))
                values = steps, asked.n[a:b], asked.degree[a:b], asked.tails[x:y], asked.m[x:y]
                for column, value in zip(columns[2:], values):
                    column.append(_pack(value))
            arrays = [pa.array(v, t) for v, t in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, ["bucket", "block", *_ASKED])

    def answer(table):
        import pyarrow as pa

        questions = []
        for parts in zip(*(table[c].to_pylist() for c in _ASKED)):
            heads, n, degree, tails, m = map(_unpack, parts)
            numbers = (v.astype(np.int64) for v in (n, degree))
            questions.append(Followers(np.cumsum(heads, dtype=np.uint64), *numbers, tails, m.astype(np.int64)))
        answers = add_up(questions)
        known = np.concatenate([q.heads[a.n > 0] for q, a in zip(questions, answers)])
        columns = [
            table["block"],
            table["bucket"],
            pa.array([_pack(np.concatenate([a.n, a.taken, a.followers])) for a in answers], pa.binary()),
            pa.array([_pack(a.m) for a in answers], pa.binary()),
            pa.array([_pack(a.numbers[a.m > 0]) if numbered else None for a in answers], pa.binary()),
            pa.array([len(np.unique(known)), *[0] * (len(answers) - 1)], pa.int64()),
        ]
        return pa.Table.from_arrays(columns, ["block", "bucket", "heads", "tails", "numbers", "kinds"])

    asked = "bucket int, block long, " + ", ".join(f"{c} binary" for c in _ASKED)
    answers = rows.mapInArrow(put, asked).groupBy("bucket").applyInArrow(
        answer, "block long, bucket int, heads binary, tails binary, numbers binary, kinds long"
    )
    gathered = F.sort_array(F.collect_list(F.struct("bucket", "heads", "tails", "numbers"))).alias(name)
    return stored(answers, name).groupBy("block").agg(gathered, F.sum("kinds").alias(f"{name}_kinds"))


def _answered(row: dict, name: str) -> Answer:
    """The answers of all buckets to the question of a block, in its order. Numbers are of the whole corpus, -1 where a tail
    is not kept."""
    got = row[name] or []
    none = [np.zeros(0, np.int64)]
    heads = [_unpack(a["heads"]).astype(np.int64).reshape(3, -1) for a in got] or [np.zeros((3, 0), np.int64)]
    tails = [_unpack(a["tails"]).astype(np.int64) for a in got] or none
    numbers = []
    for a, m in zip(got, tails):
        own = np.full(len(m), -1)
        if a["numbers"]:
            own[m > 0] = _unpack(a["numbers"]).astype(np.int64) | a["bucket"] << 32
        numbers.append(own)
    return Answer(*np.concatenate(heads, axis=1), np.concatenate(tails), np.concatenate(numbers or none))


@dataclass
class Automaton:
    """States are numbered: 0 without a history, then words, then pairs of words that have kept followers. Arcs are numbered:
    one for each pair of words, for each triple, and for each word out of state 0. Weights are log10, -1 stands
    for an arc that is not there: its word goes along the failure arc."""

    pair_states: int
    pair_arc: np.ndarray
    triple_arc: np.ndarray
    word_arc: np.ndarray
    weight: np.ndarray
    to: np.ndarray
    backoff: np.ndarray
    failure: np.ndarray

    @classmethod
    def build(
        cls, chance: np.ndarray, words: Answer, codes: np.ndarray, heads: np.ndarray, sums: Answer, triples: np.ndarray
    ) -> Automaton:
        """``chance`` of each word by itself; ``words`` with the pairs ``codes`` (first word times number of words plus second)
        as tails; the pairs ``heads`` with the ``triples`` (first and last pair) as tails of ``sums``."""
        first, second = np.divmod(codes, len(chance))
        follows = words.followers > 0
        state_of_word = np.where(follows, np.cumsum(follows), 0)
        free = 1 - (words.taken - DISCOUNT * words.followers) / np.maximum(1, words.n)
        live = heads[sums.followers > 0]
        pair_states = 1 + int(follows.sum())
        state_of_pair = state_of_word[second]
        state_of_pair[live] = pair_states + np.arange(len(live))
        pair_free = np.ones(len(codes))
        pair_free[heads] = 1 - (sums.taken - DISCOUNT * sums.followers) / np.maximum(1, words.m[heads])
        kept = words.m > 0
        pair_chance = np.ones(len(codes))
        a, b = first[kept], second[kept]
        pair_chance[kept] = (words.m[kept] - DISCOUNT) / words.n[a] + free[a] * chance[b]
        before, last = triples
        whole = sums.m > 0
        triple_chance = np.ones(len(whole))
        before, lower = before[whole], last[whole]
        triple_chance[whole] = (sums.m[whole] - DISCOUNT) / words.m[before] + pair_free[before] * pair_chance[lower]
        arcs = np.arange(len(codes) + len(whole) + len(chance), dtype=np.int32)
        return cls(
            pair_states,
            np.where(kept, arcs[: len(codes)], -1),
            np.where(whole, arcs[len(codes) : len(codes) + len(whole)], -1),
            arcs[len(codes) + len(whole) :],
            np.log10(np.concatenate([pair_chance, triple_chance, chance])),
            np.concatenate([state_of_pair, state_of_pair[last], state_of_word]),
            np.log10(np.concatenate([[1.0], free[follows], pair_free[live]])),
            np.concatenate([np.zeros(pair_states, np.int64), state_of_word[second[live]]]),
        )

    def scores(self, lengths: np.ndarray, word: np.ndarray, pair: np.ndarray, triple: np.ndarray) -> np.ndarray:
        """The log-probability of each text: one walk from left to right that carries the state.

        ``word``, ``pair`` and ``triple`` number what ends at each token, -1 for none: an arc out of a state with a history is
        that of its history and the word. Texts are walked side by side, a token of each at a time.
        """
        two = np.where(pair >= 0, np.append(self.pair_arc, -1)[pair], -1)
        three = np.where(triple >= 0, np.append(self.triple_arc, -1)[triple], -1)
        one = self.word_arc[word]
        order = np.argsort(-lengths, kind="stable")
        begin = (np.cumsum(lengths) - lengths)[order]
        state, total = np.zeros(len(lengths), np.int64), np.zeros(len(lengths))
        steps = int(np.sort(lengths)[-SIDE_BY_SIDE]) if len(lengths) >= SIDE_BY_SIDE else 0
        active = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(steps), "right")
        for step, k in enumerate(active.tolist()):
            at, s = begin[:k] + step, state[:k]
            arc = np.where(s >= self.pair_states, three[at], -1)
            failed = (s >= self.pair_states) & (arc < 0)
            total[:k] += np.where(failed, self.backoff[s], 0)
            s = np.where(failed, self.failure[s], s)
            arc = np.where((arc < 0) & (s > 0), two[at], arc)
            total[:k] += np.where(arc < 0, self.backoff[s], 0)
            arc = np.where(arc < 0, one[at], arc)
            total[:k] += self.weight[arc]
            state[:k] = self.to[arc]
        out = np.empty(len(lengths))
        out[order] = total
        arcs = [v.tolist() for v in (self.weight, self.to, self.backoff, self.failure)]
        for k in np.flatnonzero(lengths[order] > steps).tolist():
            own = slice(begin[k] + steps, begin[k] + lengths[order[k]])
            ends_here = (v[own].tolist() for v in (one, two, three))
            out[order[k]] += self._walk(int(state[k]), *ends_here, *arcs)
        return out

    def _walk(self, state, one, two, three, weight, to, backoff, failure) -> float:
        """The rest of one text."""
        total = 0.0
        for arc, second, third in zip(one, two, three):
            if state >= self.pair_states:
                if third >= 0:
                    total += weight[third]
                    state = to[third]
                    continue
                total += backoff[state]
                state = failure[state]
            if state:
                if second >= 0:
                    arc = second
                else:
                    total += backoff[state]
            total += weight[arc]
            state = to[arc]
        return total


@dataclass(frozen=True)
class Corpus:
    """The blocks of all texts with the counts of their words and pairs, and the totals."""

    known: DataFrame
    texts: int
    tokens: int
    kinds: int

    @property
    def unseen(self) -> float:
        """Share of all words that training never saw: what the discount takes from the others."""
        return DISCOUNT * self.kinds / self.tokens if self.tokens else 1.0


def learn(docs: DataFrame) -> Corpus:
    """The first round. The driver gets totals only; all training text is counted."""
    held = stored(blocks(docs), "blocks")
    totals = [F.coalesce(F.sum(c), F.lit(0)) for c in ("train_texts", "train_tokens")]
    texts, tokens, all_tokens = held.agg(
        *totals, F.coalesce(F.sum(F.octet_length("tokens")), F.lit(0))
    ).first()
    # A packed token has more than a byte.
    buckets = max(8, max(tokens, all_tokens) // BUCKET_TOKENS + 1)

    def bucket_of(hashes: np.ndarray) -> np.ndarray:
        return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)

    counts = _exchange(held, lambda row: Block(row).words(_unpack(row["words"])), bucket_of, "counts", True)
    kinds = counts.agg(F.coalesce(F.sum("counts_kinds"), F.lit(0))).first()[0]
    # The hashes have done their work: words go by their rank in the block.
    return Corpus(held.drop("words").join(counts.drop("counts_kinds"), "block"), texts, tokens, kinds)


def scored(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model is learnt from the documents that are not held out. base_score adds up smoothed shares of single
    tokens, score log10 probabilities after the two words before, over the words of the training documents, the
    end, and one event for all unseen words. A null or empty text is an end only; a text of any length is walked as
    a whole, in a block of its own if it is long. A null doc_id is not held
    out. Rows that agree in id and text get the same scores. Without training documents every token is unseen,
    with probability one. An empty table gives no rows. Only doc_id and text are looked at.
    """
    corpus = learn(docs)
    tokens, kinds, unseen = corpus.tokens, corpus.kinds, corpus.unseen

    def ask(row):
        return Block(row).pairs(_answered(row, "counts").numbers)[0]

    def bucket_of(numbers: np.ndarray) -> np.ndarray:
        return (numbers >> np.uint64(32)).astype(np.int64)

    further = _exchange(corpus.known, ask, bucket_of, "further").drop("further_kinds")
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            T.StructField("n_tokens", T.LongType(), False),
            T.StructField("n_known", T.LongType(), False),
            T.StructField("base_score", T.DoubleType(), False),
            T.StructField("score", T.DoubleType(), False),
        ]
    )

    def run(batches) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for row in _rows(batches):
            block, words = Block(row), _answered(row, "counts")
            _, heads, triples, triple = block.pairs(words.numbers)
            chance = np.where(words.n > 0, (words.n - DISCOUNT) / max(1, tokens), unseen)
            automaton = Automaton.build(chance, words, block.codes, heads, _answered(row, "further"), triples)
            scores = automaton.scores(block.lengths, block.tokens, block.pair, triple)
            own, texts = words.n[block.tokens], len(block.lengths)
            text = np.repeat(np.arange(texts), block.lengths)
            shares = np.log10((own + 0.1) / (tokens + 0.1 * (kinds + 1))) if tokens else np.zeros(len(own))
            known = np.bincount(text, own > 0, texts).astype(np.int64)
            columns = [row["doc_ids"], block.lengths, known, np.bincount(text, shares, texts), scores]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    out = corpus.known.join(further, "block", "left").mapInArrow(run, schema)
    return out.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
