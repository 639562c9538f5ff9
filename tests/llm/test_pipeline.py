"""The pipeline's stages, each against a plain version of what it promises, each on its own input."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from stocktake.llm import divergence, mixing, secrets
from stocktake.llm.shared import written
from stocktake.llm.tokens import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark, odd_dir):
    """[(rows in, rows out)] of every stage, rows as dicts."""
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    out = []
    for name, stage in corpus_pipeline.STAGES:
        made = written(stage(spark, docs, odd_dir), "test-stage")
        out.append(([r.asDict() for r in docs.collect()], [r.asDict() for r in made.collect()]))
        if name != "packing":
            assert made.columns == docs.columns
        docs = made
    return out


def key(row):
    return tuple(str(row[k]) for k in sorted(row))


def test_quality_keeps_rows_unchanged(spark, odd_dir, stages):
    before, after = stages[0]
    verdict = {r["doc_id"]: r["kept"] for r in divergence.judge(spark.read.parquet(f"{odd_dir}/documents.parquet")).collect()}
    assert Counter(map(key, after)) == Counter(key(r) for r in before if verdict[r["doc_id"]])
    for r in after:
        assert len(WORD.findall(r["text"])) >= 10


def test_near_duplicates_leave_the_first_of_each_group(stages):
    before, after = stages[1]
    sets = {}
    for r in before:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
        sets[r["doc_id"]] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    assert len(after) < len(before)
    assert Counter(map(key, after)) == Counter(key(r) for r in before if find(r["doc_id"]) == r["doc_id"])


def test_secrets_are_replaced_and_nothing_else_changes(spark, stages):
    before, after = stages[2]
    names = list(before[0])
    frame = spark.createDataFrame([tuple(r[n] for n in names) for r in before], "doc_id long, text string, lang string, source string, n_chars long, size long, hash string, start string, day date")
    spans = {r["doc_id"]: [(s["start"], s["end"]) for s in r["_spans"]] for r in secrets.scan_secrets(frame).collect()}
    got = {r["doc_id"]: r for r in after}
    assert len(got) == len(after) == len(before)
    assert any(spans.values())
    for r in before:
        merged = []
        for lo, hi in sorted(spans[r["doc_id"]]):
            if merged and lo < merged[-1][1]:
                merged[-1][1] = max(hi, merged[-1][1])
            else:
                merged.append([lo, hi])
        text = r["text"]
        for lo, hi in reversed(merged):
            text = text[:lo] + "[SECRET]" + text[hi:]
        assert got[r["doc_id"]] == r | {"text": text, "n_chars": len(text) if merged else r["n_chars"]}


def test_mix_repeats_rows_as_planned(spark, stages):
    before, after = stages[3]
    names = list(before[0])
    frame = spark.createDataFrame([tuple(r[n] for n in names) for r in before], "doc_id long, text string, lang string, source string, n_chars long, size long, hash string, start string, day date")
    plan = [r.asDict() for r in mixing.mix(frame).collect()]
    copies = {r["doc_id"]: r["copies"] for r in plan}
    assert Counter(map(key, after)) == Counter({key(r): copies[r["doc_id"]] for r in before if copies[r["doc_id"]]})
    source = {r["doc_id"]: r["source"] for r in before}
    taken, target, longest = Counter(), {}, Counter()
    for r in plan:
        s = source[r["doc_id"]]
        assert r["size"] == len(WORD.findall(next(b["text"] for b in before if b["doc_id"] == r["doc_id"])))
        taken[s] += r["taken"]
        target[s] = r["target"]
        longest[s] = max(longest[s], r["size"])
    for s in target:
        assert abs(taken[s] - target[s]) <= longest[s]


def test_packing_holds_every_id_once(stages):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    before, after = stages[4]
    expected = Counter()
    lengths = 0
    for r in before:
        ids = np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        lengths += len(ids)
        for at in range(0, len(ids), 4096):
            part = ids[at:at + 4096]
            expected[r["doc_id"], at, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in after) == expected
    sequences = defaultdict(list)
    for r in after:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    assert 4096 * len(sequences) <= 1.1 * lengths + 2 * 4096
