"""Every query against its plain form on planted rows, and on empty tables."""

import math
import random
import textwrap
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from tests.llm import brute
from tidemark.llm import licenses, line_dedup, packing, quality_model, quality_rules, registry, secrets, simhash
from tidemark.llm.decontamination import contamination, decontaminated
from tidemark.llm.tokens import TextEncoder

QUERIES, ORACLES = registry.load()
WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def named(prefix):
    return next(f for n, f in QUERIES.items() if n.startswith(prefix + "_"))


def rows(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=repr)


def check(spark, folder, op, columns, expected):
    assert rows(named(op)(spark, folder), *columns) == sorted(expected, key=repr)


def test_op1(spark, folder, planted):
    check(spark, folder, "op1", ("doc_id", "n_lines", "n_dropped", "text"), brute.line_dedup(planted[0]))
    assert any(r[2] for r in brute.line_dedup(planted[0]))


def test_op1_long_lines_take_fewer_pages(spark):
    rng = random.Random(6)
    passage = " ".join(f"w{k}" for k in range(80))
    texts = [" ".join(f"x{rng.random()}" for _ in range(8)) + (f"\n {passage}" if k < 40 else "\nshort common line" if k < 90 else "") for k in range(1000)]
    texts += ["one text\ncopied as a whole " + "very often " * 30] * 100
    docs = [{"doc_id": k, "source": "s", "text": t} for k, t in enumerate(texts)]
    found = line_dedup.without_boilerplate(spark.createDataFrame([(d["doc_id"], d["source"], d["text"]) for d in docs], "doc_id bigint, source string, text string"), counts=("n", "d"))
    assert rows(found, "doc_id", "n", "d", "text") == sorted(brute.line_dedup(docs), key=repr)
    assert [sum(r[2] for r in brute.line_dedup(docs)[low:high]) for low, high in ((0, 40), (40, 90), (1000, 1100))] == [40, 0, 0]


def test_op2(spark, folder, planted):
    """Every row's score added up by hand from the fitted tables, and who was held out."""
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_model.learn(docs, labels, "quality", max_rows=20_000)
    want = []
    for d in planted[0]:
        values = quality_model.features_of((d["text"] or "").encode())
        bins = [sum(v >= e for e in edges) for v, edges in zip(values, model.edges)]
        logit = model.intercept + sum(t[b] for t, b in zip(model.tables, bins)) + sum(t[model.coarse[a][bins[a]]][model.coarse[b][bins[b]]] for a, b, t in model.pairs)
        score = 1 / (1 + math.exp(-logit))
        want.append((d["doc_id"], d["doc_id"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 5 == 0, round(score, 9), int(score >= 0.3)))
    found = [(r["doc_id"], r["held_out"], round(r["score"], 9), r["predicted"]) for r in named("op2")(spark, folder).collect()]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    assert len({w[1] for w in want}) == 2 and len({w[3] for w in want}) == 2


def test_op2_features_of_long_texts_are_those_of_the_whole(monkeypatch):
    text = ("\n".join(f"Word{k % 700}, and {k % 13} {'X' * (k % 5)} same same line." for k in range(4000)) + " é").encode()
    whole = quality_model.features_of(text)
    words = text.split()
    assert whole[4:8] == pytest.approx([len(set(words)) / len(words), max(Counter(words).values()) / len(words), sum(a == b for a, b in zip(words, words[1:])) / len(words),
                                        len(set(zip(words, words[1:]))) / (len(words) - 1)])
    for part in (1000, 64 << 10):
        monkeypatch.setattr(quality_model, "PART", part)
        assert quality_model.features_of(text) == whole
        assert len(list(quality_model.parts_of(text))) > 1 and b"".join(quality_model.parts_of(text)) == text


def test_op3(spark, folder, planted):
    want = brute.decontamination(*planted)
    assert sum(w[-1] for w in want) > 4 and any(w[2] and not w[-1] for w in want)
    check(spark, folder, "op3", ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"), want)


def test_op3_in_blocks(spark, folder, planted):
    docs, items = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    found = contamination(docs, items, block_words=40)
    assert rows(found, "doc_id", "n_words", "n_hit", "contaminated") == sorted(((w[0], w[1], w[2], w[5]) for w in brute.decontamination(*planted)), key=repr)


def test_decontaminated_texts_hold_no_window(spark, folder, planted):
    docs, items = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    kept = [r.asDict() for r in decontaminated(docs, items).collect()]
    want = brute.decontamination(*planted)
    assert len(kept) == sum(not w[-1] for w in want)
    before = {d["doc_id"]: d["text"] for d in planted[0]}
    clean = {w[0] for w in want if not w[2]}
    assert all(r["text"] in {d["text"] for d in planted[0] if d["doc_id"] == r["doc_id"]} for r in kept if r["doc_id"] in clean)
    assert all(len(r["text"]) < len(before[r["doc_id"]]) for r in kept if r["doc_id"] is not None and r["doc_id"] not in clean)


def test_op4(spark, folder, planted):
    check(spark, folder, "op4", ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256"), brute.secrets(planted[0]))
    spans = {r["doc_id"]: r["spans"] for r in named("op4")(spark, folder).collect()}
    for d in planted[0]:
        base = [f"{name}:{a}:{b}" for a, _, name, b in brute.secret_spans(d["text"])]
        if d["doc_id"] is not None and d is not planted[0][-2]:
            assert set(base) <= set(spans[d["doc_id"]].split(",")) | {""}
        for span in filter(None, (spans[d["doc_id"]] or "").split(",")):
            assert int(span.split(":")[1]) < int(span.split(":")[2])


def test_op4_scores_tokens_that_base_spans_cover_in_part(spark):
    """A prefixed key with a run of hex digits in it, one that is such a run, one in an assignment, and a plain identifier."""
    ratios = [1.0] * secrets.ASCII**2
    texts = ["key sk_live_0123456789abcdef0123Zq8Xr0Lm end", "0123456789abcdef0123456789", "token=0123456789abcdefABCDEFGH01", "short 0123456789abcdef x", "free Zq8Xr0LmZq8Xr0LmZq8Xr0Lm"]
    found = secrets.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), ratios).orderBy("doc_id").collect()
    spans = [[texts[k][s["start"]:s["end"]] for s in r["model"]] for k, r in enumerate(found)]
    assert spans == [["sk_live_0123456789abcdef0123Zq8Xr0Lm"], [], ["token=0123456789abcdefABCDEFGH01"][:0], [], ["Zq8Xr0LmZq8Xr0LmZq8Xr0Lm"]]
    assert [len(r["base"]) for r in found] == [1, 1, 2, 1, 0]


def test_many_matches_in_one_text(spark):
    text = "é password=abcdefghijkl " * 700
    found = secrets.base_spans(__import__("pyspark.sql.functions", fromlist=["x"]).col("text"))
    spans = spark.createDataFrame([(text,)], "text string").select(found.alias("s")).first()["s"]
    assert [(s["start"], s["end"]) for s in spans] == [(a, b) for a, _, _, b in brute.secret_spans(text)]


def test_markov_ratio_tells_random_from_ordinary(spark):
    import base64
    import hashlib

    from pyspark.sql import functions as F
    ordinary = ["get_user_name", "parse_input_file", "connectionHandler", "maximumRetryCount", "readLineFromBuffer", "compute_running_totals"]
    noise = [base64.b64encode(hashlib.sha256(str(k).encode()).digest()).decode() for k in range(200)]
    samples = spark.createDataFrame([(s, 0) for s in ordinary * 20] + [(s, 1) for s in noise[:150]], "sample string, random int")
    ratios = secrets.log_ratios(samples)
    tested = spark.createDataFrame([(s,) for s in noise[150:] + ["write_user_file", "bufferConnectionCount"]], "s string")
    found = [r[0] for r in tested.select(secrets.ratio_of(F.col("s"), secrets.table_of(ratios))).collect()]
    assert min(found[:50]) > 0 > max(found[50:])
    assert set(secrets.log_ratios(samples.limit(0))) == {0.0}


def test_op5(spark, folder, planted):
    want = brute.simhash(planted[0])
    assert len({w[2] for w in want}) < len(want) - 12
    check(spark, folder, "op5", ("doc_id", "fingerprint", "component_id"), want)


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_links_are_all_pairs_within_the_radius(spark, radius):
    rng = random.Random(radius)
    prints = {rng.getrandbits(64) for _ in range(60)} | {0, 2**64 - 1}
    for p in list(prints)[:20]:
        prints |= {p ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 4))) & (2**64 - 1) for _ in range(8)}
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    found = {tuple(r) for r in simhash.links(spark.createDataFrame([(p,) for p in signed], "fp bigint"), radius).collect()}
    want = {(min(a, b), max(a, b)) for a in signed for b in signed if a != b and ((a ^ b) & (2**64 - 1)).bit_count() <= radius}
    assert found == want


def test_components_of_chains_and_stars(spark):
    rng = random.Random(3)
    names = list(range(400))
    rng.shuffle(names)
    pairs = [(names[k], names[k + 1]) for k in range(149)] + [(names[150], names[k]) for k in range(151, 300)] + [(names[k], names[k + 1]) for k in range(300, 399, 2)]
    frame = spark.createDataFrame([(min(p), max(p)) for p in pairs], "a bigint, b bigint")
    found = {r["node"]: r["root"] for r in simhash.components(frame).collect()}
    assert {found[n] for n in names[:150]} == {min(names[:150])}
    assert {found[n] for n in names[150:300]} == {min(names[150:300])}
    assert all(found[names[k]] == min(names[k], names[k + 1]) for k in range(300, 399, 2))


def test_op6(spark, folder, planted):
    check(spark, folder, "op6", ("doc_id", "start", "n_tokens", "ids_crc32"), brute.token_files(planted[0], WORDS))


def test_op7(spark, folder, planted):
    check(spark, folder, "op7", ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"), brute.license_base(planted[0]))
    want = sorted((repr(d["doc_id"]), ",".join(sorted(brute.template_labels(d["text"], licenses.TEMPLATES) | set(filter(None, b[5].split(","))))))
                  for d, b in zip(planted[0], brute.license_base(planted[0])))
    found = named("op7")(spark, folder).collect()
    assert sorted((repr(r["doc_id"]), r["labels"]) for r in found) == want
    assert {"mit", "cc-by-nc-4.0", "gpl-3.0"} <= {x for _, labels in want for x in labels.split(",")}
    assert all(0 <= r["score"] <= 1 for r in found)


@pytest.mark.parametrize("width", [24, 40, 70])
def test_op7_finds_templates_over_line_breaks(spark, width):
    rng = random.Random(width)
    filler = lambda n: " ".join(rng.choice(["la", "casa", "grande", "verde", "sol"]) for _ in range(n))
    texts = []
    for _, template in licenses.TEMPLATES:
        body = f"{filler(rng.randint(0, 90))} {template} {filler(rng.randint(0, 60))}"
        texts.append("\n".join(("# " if width == 40 else "") + line for line in textwrap.wrap(body, width, break_on_hyphens=False)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r["doc_id"]: set(r["labels"]) for r in licenses.scan(docs).collect()}
    assert all(label in found[k] for k, (label, _) in enumerate(licenses.TEMPLATES))
    assert found == {k: brute.template_labels(t, licenses.TEMPLATES) for k, t in enumerate(texts)}


def test_op8(spark, folder, planted):
    check(spark, folder, "op8", ("doc_id", "n_bytes", "n_tokens", "over_limit"), brute.token_counts(planted[0], WORDS))


def test_op9(spark, folder, planted):
    found = named("op9")(spark, folder)
    assert rows(found, "doc_id", "piece", "start", "length", "ids_crc32") == sorted(brute.pieces(planted[0], BYTES), key=repr)
    check_layout([tuple(r) for r in found.select("sequence_id", "offset", "length").collect()], 2048)


def check_layout(slots, capacity):
    held = {}
    for sequence, offset, length in slots:
        held.setdefault(sequence, []).append((offset, length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(9)
    for capacity in (10, 64, 500):
        for _ in range(25):
            lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 400))]
            counts = {n: lengths.count(n) for n in set(lengths)}
            plan = packing.plan_slots(counts, capacity)
            slots = []
            for length, low, high, first, per, offset in plan:
                slots += [(first + (r - low) // per, offset + (r - low) % per * length, length) for r in range(low, high)]
            assert sorted(s[2] for s in slots) == sorted(lengths)
            free = []
            for length in sorted(lengths, reverse=True):
                fits = [f for f in free if f >= length]
                room = min(fits) if fits else capacity
                if fits:
                    free.remove(room)
                free.append(room - length)
            assert check_layout(slots, capacity) == len(free)


def test_op10(spark, folder, planted):
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    check(spark, folder, "op10", columns, brute.quality_base(planted[0]))
    assert not any(r["kept"] and r["base_failed"] for r in named("op10")(spark, folder).collect())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty_folder, name):
    assert QUERIES[name](spark, empty_folder).collect() == []


@pytest.mark.parametrize("least", [5, 15, 200])
def test_op10_verdicts(spark, folder, planted, monkeypatch, least):
    monkeypatch.setattr(quality_rules, "MIN_ROWS", least)
    want = brute.kept(planted[0], least)
    assert {w[1] for w in want} == {True, False}
    check(spark, folder, "op10", ("doc_id", "kept"), want)


def test_op2_learns_what_the_labels_mark():
    rng = random.Random(4)
    good = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(20, 300))) + "." for _ in range(300)]
    bad = [" | ".join(t.split(" ")) if k % 4 < 2 else t.upper().replace(" ", "!! ") for k, t in enumerate(good[:100])]
    x = np.array([quality_model.features_of(t.encode()) for t in good + bad])
    y = np.array([1.0] * len(good) + [0.0] * len(bad))
    model = quality_model.fit(x[::2], y[::2])
    assert ((model.score(x[1::2]) >= 0.3) == y[1::2]).mean() > 0.98
    assert quality_model.fit(x[:0], y[:0]).score(x[:3]).tolist() == [0.5] * 3
    assert len(model.pairs) > 0 and 0 <= float(model.score(np.array([quality_model.features_of(b"")]))[0]) <= 1


def test_op1_without_broadcast(spark, folder, planted, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", -1)
    check(spark, folder, "op1", ("doc_id", "n_lines", "n_dropped", "text"), brute.line_dedup(planted[0]))


@pytest.mark.parametrize("percent", [5, 15, 20])
def test_op10_rejects_as_much_as_is_junk(spark, percent):
    rng = random.Random(percent)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7)))
    docs = []
    for k in range(600):
        words, junk = [word() for _ in range(120)], k % 100 < percent
        docs.append((k, " ".join(w + "|" if junk and k % 2 else w * 3 if junk else w for w in words), "en", f"s{k // 300}"))
    found = quality_rules.apply_rules(spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string"))
    assert {r["doc_id"] for r in found.where("NOT kept").collect()} == {k for k in range(600) if k % 100 < percent}


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_frequent_words_stay_known(name):
    """Words that keep coming back between ever new ones are encoded once, however full the table gets; ids are the library's."""
    path = public_tokenizers.path(name)
    tokens, frequent = TextEncoder(path, (7,), limit=400), [f"often{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(100)]
    asked, library = [], tokens.library
    tokens.library = lambda texts: asked.extend(" ".join(texts).split()) or library(texts)
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = [" ".join([*frequent, *(f"rare{letters[k % 26]}{letters[k // 26]}{a}{b}%%" for a in letters for b in "xyzuvw")]) for k in range(30)]
    for text in texts:
        ids, counts = tokens.encode([text.encode()] * 2)
        own = [*tokens.tokenizer.encode(text, add_special_tokens=False).ids, 7]
        assert ids.tolist() == own * 2 and counts.tolist() == [len(own)] * 2
    assert asked.count("oftenba") <= 2 and len(tokens.known) < 800
