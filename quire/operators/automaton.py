"""Finding a lexicon of any size in texts by an Aho-Corasick automaton over words.

Texts and names become alternating words and gaps; the automaton walks over them and
reports every name that equals a run of them.  A text is read once, whatever the number
of names, and nothing is exploded or shuffled.  A lexicon is written once and cut into
shards of bounded bytes; texts meet one shard after the other, so that no task holds
more than one.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.session import scratch_folder, spread

SHARD_BYTES = 32 << 20  # of names, that a task holds at a time
MAX_SHARDS = 16
# \w of this pattern is what text.WORD_CHAR spells out.
TOKENS = re.compile(r"\w+|\W+")
WORDS = re.compile(r"\w+")


class WordAutomaton:
    """Entries (numbers) of names found in token sequences.

    Names of one token are looked up; longer ones are states of the automaton, with the
    state of the longest other beginning to go on from where a walk ends.
    """

    def __init__(self, keys: Iterable[str]):
        self.single: dict[str, tuple[int, ...]] = {}
        self.next: list[dict[str, int]] = [{}]
        self.entries: list[list[int]] = [[]]
        for number, key in enumerate(keys):
            tokens = [key] if key.isalnum() else TOKENS.findall(key)
            if len(tokens) == 1:
                self.single[key] = (*self.single.get(key, ()), number)
            elif tokens:
                state = 0
                for token in tokens:
                    if token not in self.next[state]:
                        self.next[state][token] = len(self.next)
                        self.next.append({})
                        self.entries.append([])
                    state = self.next[state][token]
                self.entries[state].append(number)
        self.back = [0] * len(self.next)
        waiting = deque(self.next[0].values())
        while waiting:
            state = waiting.popleft()
            for token, after in self.next[state].items():
                back = self.back[state]
                while back and token not in self.next[back]:
                    back = self.back[back]
                self.back[after] = self.next[back].get(token, 0)
                # Names that end here end at the shorter beginning, too.
                self.entries[after] = self.entries[after] + self.entries[self.back[after]]
                waiting.append(after)
        self.first = set(self.next[0])
        # Gaps are tokens of the walk, and need no look otherwise but for a name made of one.
        self.tokens = TOKENS if self.first or not all(map(WORDS.match, self.single)) else WORDS

    def find(self, text: str) -> set[int]:
        tokens = self.tokens.findall(text)
        distinct, single = set(tokens), self.single
        found = {n for token in distinct if token in single for n in single[token]}
        if self.first.isdisjoint(distinct):
            return found
        state, next_, back, entries = 0, self.next, self.back, self.entries
        for token in tokens:
            while state and token not in next_[state]:
                state = back[state]
            state = next_[state].get(token, 0)
            if state and entries[state]:
                found.update(entries[state])
        return found


def prepared(lexicon: DataFrame) -> DataFrame:
    """(entity_type, key, ord, name): of names that differ in case only the first by ``ord`` stands for a type."""
    names = lexicon.filter("name IS NOT NULL").withColumn("key", F.lower("name")).groupBy("entity_type", "key")
    return names.agg(F.min(F.struct("ord", "name")).alias("e")).select("entity_type", "key", "e.ord", "e.name")


def extract_by_automaton(papers: DataFrame, text: Column, lexicon: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame | None:
    """(paper_id, ord, entity_type, name) of papers with ``id``, or None if the lexicon needs more than MAX_SHARDS.

    ``lexicon`` (entity_type, name, ord) is computed and written once.  Ids of papers
    must be distinct.  A null text holds no names.
    """
    spark = papers.sparkSession
    path = scratch_folder(spark, "lexicon")
    names = prepared(lexicon)
    names.write.parquet(path)
    names = spark.read.schema(names.schema).parquet(path)
    size = names.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("key") + F.octet_length("name") + 16), F.lit(0)).alias("bytes")).first()
    shards = max(1, -(-size["bytes"] // shard_bytes))
    if shards > MAX_SHARDS:
        return None
    texts = spread(papers.select(F.col("id").alias("paper_id"), F.lower(text).alias("text")))
    schema = T.StructType([texts.schema["paper_id"], *(names.schema[c] for c in ("ord", "entity_type", "name"))])
    parts = []
    for shard in range(shards):
        own = names if shards == 1 else names.filter(F.pmod(F.xxhash64("key"), F.lit(shards)) == shard)
        parts.append(texts.mapInArrow(_finder(spark.sparkContext.broadcast(own.toArrow())), schema))  # at most about shard_bytes
    return reduce(DataFrame.unionAll, parts)


def _finder(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: pa.Table = shared.value
        automaton = WordAutomaton(names["key"].to_pylist())
        entries = [names[c].combine_chunks() for c in ("ord", "entity_type", "name")]
        for batch in batches:
            papers, found = [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                if text:
                    numbers = automaton.find(text)
                    papers += [row] * len(numbers)
                    found += numbers
            numbers = pa.array(found, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(papers, pa.int64())), *(e.take(numbers) for e in entries)], ["paper_id", "ord", "entity_type", "name"]
            )

    return run
