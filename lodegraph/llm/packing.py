"""Filling containers of fixed capacity with texts, measured in tokens of a public tokenizer.

Hierarchical residual packing: every task packs its own items best-fit, largest first, and emits the bins that
are nearly full; the others become items of the next round, in which fewer tasks pack bins of several
tasks together, and so on up a tree until the bins stop merging.  The number of tasks of a round follows from
the number of underfull bins, so that none gets more than ``BINS_PER_TASK`` of them.

A text longer than a container is cut into full containers and a rest; any other text stays whole.  Null
texts and texts without tokens take no room and are left out.  Repeated rows are items of their own, also
under the same id.  A null id is kept.  Other columns are not read; empty tables give an empty result.

Scale: only (id, piece, tokens) leaves the tokenizing task; a bin travels with the list of its items, which the
capacity bounds.  Each round is written to the shared folder, so a lost executor repeats no earlier round.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.plans.storage import Workspace

CAPACITY = 2048
#: Bins at least so full are emitted at once; the rest of the tree sees only emptier ones.
NEARLY_FULL = 0.99
#: Underfull bins that a task of a merging round gets, and how many tasks' bins one task merges.
BINS_PER_TASK, FAN_IN = 50_000, 8
#: Rounds go on while they take away at least this share of the underfull bins.
LEAST_GAIN = 0.02
#: The vocabulary, as a folder (see its README) and a file of merge ranks in it.
TOKENIZERS, RANKS = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
#: Bytes of a vocabulary that may be sent to the tasks.
VOCABULARY_LIMIT = 64 << 20
#: Fixed value: the pre-tokenizer pattern that belongs to the ranks.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

BIN = "bin string, used int, items array<struct<doc_id:bigint,piece:int,first_token:int,n_tokens:int>>"


@lru_cache(2)
def vocabulary(folder: str = TOKENIZERS, ranks: str = RANKS) -> bytes:
    """The merge ranks as stored, read where the plan is made; tasks get them with the job."""
    with open(f"{folder}/{ranks}", "rb") as file:
        data = file.read(VOCABULARY_LIMIT + 1)
    if len(data) > VOCABULARY_LIMIT:
        raise ValueError(f"the vocabulary {folder}/{ranks} is larger than {VOCABULARY_LIMIT} bytes")
    return data


@lru_cache(2)
def encoding(data: bytes | None = None):
    """The tokenizer of a vocabulary, built once per worker process."""
    import tiktoken

    merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, (data or vocabulary()).splitlines())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})


def pieces(n_tokens: int, capacity: int) -> list[tuple[int, int, int]]:
    """(piece, first token, tokens) of a text: itself, or full containers and a rest."""
    return [(k, start, min(capacity, n_tokens - start)) for k, start in enumerate(range(0, n_tokens, capacity))]


def best_fit(loads: list[int], capacity: int) -> list[list[int]]:
    """Indexes of ``loads`` by bin: best fit, largest first.

    Open bins are kept by their room; one bit per room that occurs finds the least sufficient one.
    """
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for n in sorted(range(len(loads)), key=loads.__getitem__, reverse=True):
        size = loads[n]
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            target = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[target].append(n)
        else:
            room, target = capacity, len(bins)
            bins.append([n])
        by_room[room - size].append(target)
        rooms |= 1 << (room - size)
    return bins


def _packed(loads: list[int], contents: list[list], capacity: int, level: int, flush: int = 0) -> pd.DataFrame:
    """Bins named by round, task and flush of the task: no two of a result share a name, and a repeated task gives the same names."""
    task = TaskContext.get()
    where = f"{level}-{task.partitionId() if task else 0}-{flush}"
    rows = []
    for k, members in enumerate(best_fit(loads, capacity)):
        rows.append((f"{where}-{k}", sum(loads[m] for m in members), [x for m in members for x in contents[m]]))
    return pd.DataFrame(rows, columns=["bin", "used", "items"])


def first_round(documents: DataFrame, capacity: int, folder: str, ranks: str) -> DataFrame:
    """Bins of each task's own texts; a task with more than ``10 * BINS_PER_TASK`` pieces packs them in several flushes."""

    sent = documents.sparkSession.sparkContext.broadcast(vocabulary(folder, ranks))
    at_once = 10 * BINS_PER_TASK

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = encoding(sent.value).encode_ordinary
        loads, contents, flush = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                for piece, start, n in pieces(len(count(text)), capacity):
                    loads.append(n)
                    contents.append([(None if pd.isna(doc_id) else int(doc_id), piece, start, n)])
            if len(loads) >= at_once:
                yield _packed(loads, contents, capacity, 0, flush)
                loads, contents, flush = [], [], flush + 1
        yield _packed(loads, contents, capacity, 0, flush)

    return documents.filter("text is not null and text <> ''").select("doc_id", "text").mapInPandas(pack, BIN)


def merge_round(bins: DataFrame, tasks: int, capacity: int, level: int) -> DataFrame:
    """Underfull bins of several tasks packed together."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loads, contents = [], []
        for batch in batches:
            loads += batch["used"].tolist()
            contents += [[(x["doc_id"], x["piece"], x["first_token"], x["n_tokens"]) for x in items] for items in batch["items"]]
        yield _packed(loads, contents, capacity, level)

    return bins.repartition(tasks).mapInPandas(pack, BIN)


def containers(documents: DataFrame, capacity: int = CAPACITY, folder: str = TOKENIZERS, ranks: str = RANKS) -> DataFrame:
    """(bin, used, items): the containers, each with the pieces in it."""
    space = Workspace(documents.sparkSession, "packing")
    limit = int(NEARLY_FULL * capacity)
    open_bins = F.count(F.when(F.col("used") < limit, 1))
    bins, seen = space.write(first_round(documents, capacity, folder, ranks), "round=0", metrics={"open": open_bins})
    done, level, left = [bins.filter(F.col("used") >= limit)], 0, seen["open"]
    tasks = max(1, space.partitions(bins) // FAN_IN)
    while left > 1:
        tasks = max(-(-left // BINS_PER_TASK), tasks)
        level += 1
        bins, seen = space.write(merge_round(bins.filter(F.col("used") < limit), tasks, capacity, level), f"round={level}", metrics={"open": open_bins})
        before, left = left, seen["open"]
        done.append(bins.filter(F.col("used") >= limit))
        if tasks == max(1, -(-left // BINS_PER_TASK)) and (tasks == 1 or left > (1 - LEAST_GAIN) * before):
            break
        tasks = max(1, tasks // FAN_IN)
    done.append(bins.filter(F.col("used") < limit))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def placed(bins: DataFrame) -> DataFrame:
    """One row per piece: (doc_id, piece, first_token, n_tokens, bin, bin_tokens)."""
    return bins.select("bin", F.col("used").alias("bin_tokens"), F.explode("items").alias("i")).select("i.doc_id", "i.piece", "i.first_token", "i.n_tokens", "bin", "bin_tokens")


def summary(bins: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(n_bins, least_bins, n_tokens, fill): how close to the least possible number of containers."""
    out = bins.agg(F.count(F.lit(1)).alias("n_bins"), F.coalesce(F.sum("used"), F.lit(0)).alias("n_tokens"))
    return out.select("n_bins", F.ceil(F.col("n_tokens") / capacity).alias("least_bins"), "n_tokens", F.round(F.col("n_tokens") / (F.col("n_bins") * capacity), 6).alias("fill"))
