"""Every stage against the plain form of its own input."""

import itertools
import random

import public_tokenizers

import corpus_pipeline
from tests.llm import brute
from tests.llm.conftest import write
from tests.llm.test_queries import check_layout, rows
from tidemark.llm import near_copies
from tidemark.llm.common import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def dicts(frame):
    return [r.asDict() for r in frame.select(*COLUMNS).collect()]


def key(d):
    return repr((d["doc_id"], d["text"]))


def test_stages(spark, folder):
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stored(stage(spark, before, folder), name)
        out[name] = before, docs
        if name != "packing":
            assert docs.columns == before.columns
    before, after = map(dicts, out["quality_classifier"])
    assert {key(d) for d in after} <= {key(d) for d in before} and 0 < len(after) <= len(before)
    assert any("|" in (d["text"] or "") for d in before)
    before, after = map(dicts, out["line_dedup"])
    assert sorted((repr(d["doc_id"]), repr(d["text"])) for d in after) == sorted((repr(r[0]), repr(r[3])) for r in brute.line_dedup(before))
    before, after = map(dicts, out["near_duplicates"])
    kept = {key(d) for d in after}
    assert len(kept) == len(after) and kept <= {key(d) for d in before}
    groups, smallest = brute.simhash([{"doc_id": k, "text": d["text"]} for k, d in enumerate(before)], size=5), {}
    for k, g in enumerate(groups):
        smallest.setdefault(g[2], []).append(k)
    chosen = [min(ids, key=lambda k: (before[k]["doc_id"] is None, before[k]["doc_id"])) for ids in smallest.values()]
    first = {before[k]["doc_id"] for k in chosen}
    assert {d["doc_id"] for d in after} <= first
    sets = [shingles(d["text"]) for d in after]
    assert not [1 for a, b in itertools.combinations(sets, 2) if similarity(a, b) >= 0.8]
    for k in chosen:  # what went besides is similar to what stays
        own = shingles(before[k]["text"])
        assert before[k]["doc_id"] in {d["doc_id"] for d in after} or any(similarity(own, s) >= 0.8 for s in sets)
    before, after = map(dicts, out["decontamination"])
    items = [r.asDict() for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    found = brute.decontamination(before, items)
    assert sorted(repr(d["doc_id"]) for d in after) == sorted(repr(f[0]) for f in found if not f[5])
    clean = {key(d) for d, f in zip(before, found) if not f[2]}
    assert clean <= {key(d) for d in after}
    before, packed = out["packing"]
    assert rows(packed, "doc_id", "piece", "start", "length", "ids_crc32") == sorted(brute.pieces(dicts(before), public_tokenizers.path("byte_bpe_50k.json")), key=repr)
    check_layout([tuple(r) for r in packed.select("sequence_id", "offset", "length").collect()], 2048)


def test_run_gives_the_stages_rows(spark, folder, empty_folder):
    assert corpus_pipeline.run(spark, folder).count() > 0
    assert corpus_pipeline.run(spark, empty_folder).count() == 0


INNER = ("_near_node", "node", "gone", "row", "key", "h1", "h2", "_near_id", "_kept", "kept", "drop", "own_host", "_hit_id", "hit_id", "hit_spans", "_quality", "score", "page", "host")


def test_columns_of_inner_names_stay(spark, planted, labels, tmp_path):
    folder = write(tmp_path, *planted, labels, INNER)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, folder), name)
        assert docs.columns == [*COLUMNS, *INNER]
        assert {tuple(r) for r in docs.select(*INNER).distinct().collect()} == {("x",) * len(INNER)}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() > 0


def shingles(text, size=5):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[k:k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def test_no_near_copies_are_left(spark, monkeypatch):
    """Copies with every 40th to 60th word or so replaced, chains of them, a large group, and texts that share only a passage."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    changed = lambda words, n: [word() if k in places else w for places in [set(rng.sample(range(len(words)), n))] for k, w in enumerate(words)]
    passage, texts = [word() for _ in range(60)], [None, "", "a b", "a  B", "c d"]
    for _ in range(15):
        base = [word() for _ in range(300)]
        texts += [" ".join(w) for w in (base, changed(base, 3), changed(base, 5), changed(changed(base, 5), 5), changed(base, 40))]
        texts.append(" ".join(passage + base[:50]))
    texts += [" ".join(changed(passage * 5, 2)) for _ in range(100)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    sets = [shingles(t) for t in texts]
    copies = [(a, b) for a in range(len(texts)) for b in range(a) if similarity(sets[a], sets[b]) >= 0.8]
    prints = [brute.fingerprint(t, 5) for t in texts]
    groups = [{k} for k in range(len(texts))]
    for a, b in [*copies, *((a, b) for a in range(len(texts)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2)]:
        one, other = (next(g for g in groups if k in g) for k in (a, b))
        if one is not other:
            groups.remove(other)
            one |= other
    assert sum((prints[a] ^ prints[b]).bit_count() > 2 for a, b in copies) > 20
    for rounds in (1, 3):
        monkeypatch.setattr(near_copies, "ROUNDS", rounds)
        kept = {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs.union(docs.limit(9)), "").collect()}
        assert not [p for p in copies if kept >= set(p)]
        assert all(any(k in kept for k in group) for group in groups)


def test_passages_in_common_are_told_apart_without_comparing_all(spark, monkeypatch):
    """Texts that share a long passage and are no copies: pairs to verify grow with the texts, not with their square."""
    rng = random.Random(2)
    passage = [f"p{k}" for k in range(100)]
    pairs = {}
    plain = near_copies.similar
    for n in (200, 400):
        texts = [" ".join([*passage, *(f"w{rng.random()}" for _ in range(18))]) for _ in range(n)]
        texts += [" ".join(t.split()[:-1]) for t in texts[:40]]  # near copies among them
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
        counted = []
        monkeypatch.setattr(near_copies, "similar", lambda p, *rest: counted.append(p.count()) or plain(p, *rest))
        assert near_copies.without_near_copies(docs).count() == n
        pairs[n] = sum(counted)
    assert pairs[400] < 3 * pairs[200] < 3 * 8 * 200
