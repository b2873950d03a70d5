"""Each stage of the pipeline, on its own input, against a plain version in Python; odd rows; empty tables."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from bytetree.llm import mixing as M
from bytetree.llm import quality as Q
from tests_llm_tools import brute_overlap, plain_jump, prose, rows, DDL

SF = "/root/testdata/sf0.001"
STAGE = dict(P.STAGES)


@pytest.fixture(scope="module")
def stages(spark):
    """name -> (rows a stage read, rows it gave), for the given tables."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet").cache(), {}
    for name, stage in P.STAGES:
        made = stage(spark, docs, SF).cache()
        assert name == "sharding" or made.columns == docs.columns
        out[name] = docs.collect(), made.collect()
        docs = made
    return out


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def test_quality_stage(spark, stages):
    read, gave = stages["quality"]
    scores = {r.id: r.quality_score for r in Q.score(table(spark, "documents"), table(spark, "labels")).collect()}
    assert {r.doc_id for r in gave} == {r.doc_id for r in read if scores[r.doc_id] >= 0.5} and len(gave) < len(read)
    labels = {r.doc_id: r.quality for r in table(spark, "labels").collect()}
    kept = {r.doc_id for r in gave}
    assert np.mean([(i in kept) == bool(y) for i, y in labels.items()]) > 0.97


def test_near_duplicate_stage(stages):
    read, gave = stages["near_duplicates"]
    sets = []
    for r in read:
        w = r.text.lower().split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]))
    root, unsure = list(range(len(read))), set()
    for i in range(len(read)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if min(len(a), len(b)) < 0.7 * max(len(a), len(b)):
                continue
            s = len(a & b) / len(a | b)
            if abs(s - 0.8) < 0.04:
                unsure |= {i, j}
            elif s > 0.8:
                x, y = sorted((root[i], root[j]))
                root = [x if k == y else k for k in root]
    doubtful = {root[i] for i in unsure}
    kept = {r.doc_id for r in gave}
    for k in set(root) - doubtful:
        group = [read[i].doc_id for i in range(len(read)) if root[i] == k]
        assert kept & set(group) == {min(group)}
    assert len(gave) < len(read)


def test_decontamination_stage(spark, stages):
    read, gave = stages["decontamination"]
    items = [(r.item_id, r.text) for r in table(spark, "benchmark").collect()]
    want = set()
    for r in read:
        n, hit, owners = brute_overlap(r.text, items)
        assert all(len(t.split()) >= 8 for _, t in items)
        if not owners or hit < min(8, n):
            want.add(r.doc_id)
    assert {r.doc_id for r in gave} == want and len(gave) < len(read)


def test_mixing_stage(stages):
    """Copies, and their order, from a schedule written out slot by slot."""
    read, gave = stages["mixing"]
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in read}
    by = {}
    for r in read:
        by.setdefault(r.source, []).append(r.doc_id)
    order = sorted(by)
    total = {s: sum(size[i] for i in by[s]) for s in order}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    full, goal = set(), {}
    while True:  # targets that stop, one after the other
        left, w = sum(total.values()) - sum(3 * total[s] for s in full), sum(weight[s] for s in order if s not in full)
        goal = {s: 3 * total[s] if s in full else left * weight[s] / w for s in order}
        over = {s for s in order if goal[s] > 3 * total[s]}
        if not over:
            break
        full |= over
    slots, first = {}, 0
    for s in order:
        words = int(goal[s] + 0.5)
        times, rest = divmod(words, total[s])
        blocks = -(-total[s] // M.BLOCK)
        slots[s] = first, times * blocks + -(-rest // M.BLOCK), blocks, rest
        first += slots[s][1]
    bits = max(0, (first - 1).bit_length())
    places = []
    for s in order:
        at, n, blocks, rest = slots[s]
        line = sorted(int(f"{j:0{bits}b}"[::-1], 2) for j in range(at, at + n))
        begin = 0
        for i in sorted(by[s], key=lambda i: ((i % 2**31 * 2654435761 + 97531) % 2**32, i)):
            for rank, p in enumerate(line):
                limit = rest - rank % blocks * M.BLOCK if rank == n - 1 and rest else M.BLOCK
                if size[i] and rank % blocks == begin // M.BLOCK and begin % M.BLOCK < limit:
                    places.append((p, i))
            begin += size[i]
    assert sorted(r.doc_id for r in gave) == sorted(i for _, i in places)


def test_written_mix_is_in_order(spark):
    docs = table(spark, "documents")
    position = {r.id: r.position for r in M.mix_sources(docs).rows.collect()}
    seen, line = set(), []
    for part in STAGE["mixing"](spark, docs, SF).select("doc_id").rdd.glom().collect():
        for r in part:
            if r.doc_id not in seen:
                seen.add(r.doc_id)
                line.append(position[r.doc_id])
    assert line == sorted(line) and len(line) > 50


def test_sharding_stage(stages):
    read, gave = stages["sharding"]
    assert sorted((r.doc_id, r.size, r.text_crc32, r.shard) for r in gave) == sorted((r.doc_id, len(r.text.encode()) + 1, zlib.crc32(r.text.encode()), plain_jump(r.doc_id, P.SHARDS)) for r in read)
    for s in {r.shard for r in gave}:
        assert sorted(r.slot for r in gave if r.shard == s) == list(range(sum(r.shard == s for r in gave)))


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES])
def test_odd_rows_and_empty_tables(spark, name):
    odd = spark.createDataFrame(rows(), DDL).repartition(3).withColumn("position", F.lit(1)).withColumn("copy", F.lit("c")).withColumn("path", F.lit("p"))
    for docs in (odd, odd.limit(0)):
        out = STAGE[name](spark, docs, SF)
        n = out.count()
        if name != "sharding":
            assert out.columns == docs.columns
        if docs is not odd:
            assert n == 0
        elif name == "near_duplicates":
            assert n == 8
        elif name == "decontamination":
            assert n == len(rows())
        elif name == "sharding":
            assert n == len(rows())
        else:
            assert n > 0


def test_run_on_the_given_and_on_empty_tables(spark, stages, tmp_path):
    got = P.run(spark, SF).collect()
    assert sorted(map(str, got)) == sorted(map(str, stages["sharding"][1]))
    for t in ("documents", "labels", "benchmark"):
        table(spark, t).limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
