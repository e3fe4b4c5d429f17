"""The training-data operators against brute-force versions and round trips."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from graphloom.llm import classifier, components, decontaminate, html_text, jaccard_join, packing, pii, quality_rules, store, substring_dedup, textscan, token_files, tokens, warc
from graphloom.llm.queries import tokenizer_path

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def documents(spark, rows, extra=True):
    """Rows (id, text) with further columns, of which some have names that operators use inside."""
    if not extra:
        return spark.createDataFrame(rows, "doc_id bigint, text string")
    return spark.createDataFrame([(a, b, None, "x", "id", 1) for a, b in rows], "doc_id bigint, text string, lang string, t string, id string, n int").repartition(3)


ODD = [(1, None), (2, ""), (3, "  \n "), (4, "word"), (5, "word"), (6, "x" * 3000), (7, "é ü 中文 " * 30), (8, "same text here " * 20), (9, "same text here " * 20), (None, "no id " * 30)]


# --- scanning ------------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB1 \n\t.é中", max_size=40)), max_size=6), st.integers(1, 40))
def test_hashes_do_not_depend_on_the_block(texts, limit):
    data, offsets = textscan.utf8(pa.array(texts, pa.string()))
    starts, ends, _ = textscan.spans(textscan.SPACED[data], offsets)
    weights = textscan.byte_weights(True)
    assert textscan.word_hashes(data, starts, ends, weights, limit).tolist() == textscan.span_hashes(data, starts, ends, weights).tolist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB1 \n\t.é中", max_size=40)), max_size=6))
def test_spans_are_regex_words(texts):
    data, offsets = textscan.utf8(pa.array(texts, pa.string()))
    starts, ends, first = textscan.spans(textscan.SPACED[data], offsets)
    found = [[data[a:b].tobytes().decode() for a, b in zip(starts[i:j], ends[i:j], strict=True)] for i, j in zip(first[:-1], first[1:], strict=True)]
    assert found == [SPACED.findall(t or "") for t in texts]


def test_chunks_keep_documents_whole():
    data, offsets = textscan.utf8(pa.array(["ab", "", None, "c" * 10, "d"]))
    parts = list(textscan.chunks(data, offsets, 3))
    assert parts[0][0] == 0 and parts[-1][1] == 5 and all(p[3][-1] == len(p[2]) for p in parts)


# --- quality rules -------------------------------------------------------------------------------------------------


def brute_counts(text):
    words = SPACED.findall(text or "")
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    seen, repeated = set(), 0
    for line in (text or "").split("\n"):
        if SPACED.search(line):
            repeated += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), repeated, len(covered)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="ab \n#|é", max_size=60), min_size=1, max_size=5))
def test_rule_counts(texts):
    counts, _ = quality_rules._scan(pa.array(texts, pa.string()))
    assert [tuple(int(counts[k][i]) for k in quality_rules.COUNTS) for i in range(len(texts))] == [brute_counts(t) for t in texts]


def test_rules_on_odd_rows(spark):
    rows = {r.doc_id: r for r in quality_rules.judge(documents(spark, ODD)).collect()}
    assert set(rows) == {x for x, _ in ODD}
    assert rows[1].n_words == 0 and rows[1].base_failed and not rows[1].kept
    assert all(tuple(rows[i][k] for k in quality_rules.COUNTS) == brute_counts(t) for i, t in ODD)
    assert quality_rules.judge(documents(spark, ODD).limit(0)).count() == 0


def prose(rnd, n=120):
    return " ".join(rnd.choice(["the", "of", "and", "to"]) if rnd.random() < 0.4 else "".join(rnd.choice("etaoin") for _ in range(rnd.randint(4, 9))) for _ in range(n)) + "."


def test_em_separates_junk(spark):
    rnd = random.Random(2)
    good = [(i, prose(rnd)) for i in range(200)]
    bars = [(1000 + i, prose(rnd).replace(" ", " | ")) for i in range(15)]
    loud = [(2000 + i, prose(rnd).upper().replace(" ", "!! ")) for i in range(15)]
    signs = [(3000 + i, prose(rnd).replace(" ", "### ")) for i in range(15)]
    docs = documents(spark, good + bars + loud + signs)
    kept = {r.doc_id for r in quality_rules.judge(docs).where("kept").collect()}
    assert kept == {i for i, _ in good}
    assert {r.doc_id for r in quality_rules.keep_good(docs).collect()} == kept
    assert quality_rules.keep_good(docs).columns == docs.columns


# --- decontamination -----------------------------------------------------------------------------------------------


def brute_marks(rows, items):
    windows = defaultdict(set)
    for i, x in items:
        w = tuple(ALNUM.findall(fold(x)))
        if w and len(w) < 10:
            windows[w].add(i)
        for k in range(len(w) - 9):
            windows[w[k : k + 10]].add(i)
    out = []
    for i, x in rows:
        w, hit, names = tuple(ALNUM.findall(fold(x))), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if w[k : k + n] in windows:
                    hit |= set(range(k, k + n))
                    names |= windows[w[k : k + n]]
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(map(str, names))).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_marks_are_brute_force(spark, block):
    rnd = random.Random(block)
    words = ["a", "B", "c", "é", "1", "dog"]
    text = lambda n: rnd.choice([" ", "-", " . "]).join(rnd.choice(words) for _ in range(rnd.randint(0, n)))
    items = [(i, rnd.choice([None, "", text(30), text(12), text(3)])) for i in range(9)] + [(1, "dog dog dog")]
    rows = [(i, rnd.choice([None, text(60), text(60)])) for i in range(60)] + ODD
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontaminate.mark(documents(spark, rows), bench, block_bytes=block)
    assert sorted(map(tuple, found.collect()), key=repr) == brute_marks(rows, items)
    clean = {r[0] for r in brute_marks(rows, items) if not r[5]}
    assert {r.doc_id for r in decontaminate.drop_contaminated(documents(spark, rows), bench, block_bytes=block).collect()} == clean


def test_marks_without_items(spark):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.mark(documents(spark, ODD), bench).where("contaminated").count() == 0
    assert decontaminate.mark(documents(spark, ODD).limit(0), bench).count() == 0


# --- Jaccard join --------------------------------------------------------------------------------------------------


def brute_components(rows):
    sets = {}
    for i, x in rows:
        w = SPACED.findall(fold(x))
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()
    parent = {i: i for i in sets}

    def top(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    return sorted((i, len(sets[i]), top(i)) for i in ids)


@pytest.mark.parametrize("seed", [0, 1])
def test_components_are_brute_force(spark, seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range([8, 300][seed])]
    base = [[rnd.choice(vocabulary) for _ in range(rnd.choice([0, 1, 3, 6, 9, 12, 16, 20, 40]))] for _ in range(15)]
    rows = []
    for i in range(130):
        w = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 2])):
            if w:
                w[rnd.randrange(len(w))] = rnd.choice([*vocabulary, f"z{rnd.randrange(40)}"])
        rows.append((i, None if rnd.random() < 0.03 else " ".join(w)))
    found = jaccard_join.join_documents(documents(spark, rows))[0]
    assert sorted(map(tuple, found.collect())) == brute_components(rows)


def test_cross_links_alone_find_all(spark, monkeypatch):
    """Without light lists and stars, the classes of equal cores must find every component."""
    monkeypatch.setattr(jaccard_join, "MAX_LIGHT", 0)
    monkeypatch.setattr(jaccard_join, "_stars", lambda lists, turn: lists.select(jaccard_join.F.col("id").alias("u"), jaccard_join.F.col("id").alias("v")).limit(0))
    rnd = random.Random(9)
    passage = [f"p{i}" for i in range(30)]
    rows = [(i, " ".join([*passage, *(f"w{rnd.randrange(400)}" for _ in range(rnd.randint(0, 9)))])) for i in range(40)]
    rows += [(100 + i, " ".join([*(f"h{k % 7}" for k in range(rnd.randint(5, 12))), *passage[: rnd.randint(0, 30)]])) for i in range(40)]
    found = jaccard_join.join_documents(documents(spark, rows))[0]
    assert sorted(map(tuple, found.collect())) == brute_components(rows)


def test_join_of_odd_rows(spark):
    found = {r[0]: tuple(r) for r in jaccard_join.join_documents(documents(spark, [*ODD, (4, "word")]))[0].collect()}
    assert found[4][2] == 4 and found[5] == (5, 1, 4) and found[9][2] == 8 and found[1] == (1, 0, 1) and found[None][2] is None
    assert {r.doc_id for r in jaccard_join.keep_one(documents(spark, ODD)).collect()} == {None, 1, 2, 3, 4, 6, 7, 8}
    assert jaccard_join.join_documents(documents(spark, ODD).limit(0))[0].count() == 0


def test_overlap_bounds():
    for a in range(1, 40):
        for b in range(1, 40):
            c = jaccard_join.overlap_needed(a, b)
            assert 100 * c >= 75 * (a + b - c) and 100 * (c - 1) < 75 * (a + b - c + 1)
            assert (b in jaccard_join.partner_sizes(a)) == (c <= min(a, b))


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(5, 5), (3, 4)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 30)}}


# --- personal data -------------------------------------------------------------------------------------------------

_BASE = [re.compile(x) for x in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def brute_base(text):
    out = []
    for k, pattern in enumerate(_BASE):
        for m in pattern.finditer(text or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = (True, k == 1 and all(int(p) <= 255 for p in m[0].split(".")), 13 <= len(d) <= 19 and pii.luhn(d), 9 <= len(d) <= 15)
            if good[k]:
                out.append((k, *m.span()))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["1", "12", "555", "0", "4111", ".", ".", "-", " ", "@", "a", "b.c", "+", "(", ")", "é", "256", "\n"]), max_size=18).map("".join))
def test_base_spans(text):
    assert pii.base_spans(text) == brute_base(text)


def test_field_labels_repeats_in_other_notation(spark):
    rows = [(i, f"call +1 (017) 555-{1000 + i} or mail joe{i}@mail.example.com from 10.0.0.{i} with 4111 1111 1111 1111 and 999{i}8") for i in range(60)]
    rows += [(100, "card 4111 1111 1111 1111, again 4111.1111.1111.1111"), (101, "room 20240 and 20241, nothing else"), *((200 + i, t) for i, t in ODD[:3]), (None, "a@b.cd")]
    got = {r.doc_id: r for r in pii.detect(documents(spark, rows)).collect()}
    text = dict(rows)[100]
    at = text.index("4111.")
    assert got[100].spans == f"card:5:24,card:{at}:{at + 19}" and got[100].n_card == 1
    assert got[101].spans == "" and got[1].n_email == 1 and got[None].n_email == 1
    for i, t in rows:
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in brute_base(t)).encode()).hexdigest()
    masked = {r.doc_id: r for r in pii.redact(documents(spark, rows), length_col="n").collect()}
    assert masked[100].text == "card [CARD], again [CARD]" and masked[100].n == len(masked[100].text) and masked[101].text == dict(rows)[101]
    assert pii.detect(documents(spark, rows).limit(0)).count() == 0


def test_secrets_and_their_repeats(spark):
    rnd = random.Random(3)
    drawn = lambda: "".join(rnd.choice("0123456789abcdef") for _ in range(40))
    rows = [(i, f'the token = "{drawn()}" of run {1000 + i}, build {drawn()[:12]}') for i in range(60)]
    again = "0a1b2c3d4e5f60718293a4b5c6d7e8f901234567"
    rows += [(100, f"api_key: {again}\nlater ({again.upper()}) and {'9' * 40}"), (101, f"commit {again}"), (102, "keyboard = mechanical-keyboards-are-loud"), (103, "PASSWORD='x'")]
    got = {r.doc_id: r for r in pii.detect(documents(spark, rows)).collect()}
    text = dict(rows)[100]
    at = text.index(again.upper())
    assert got[100].spans == f"secret:9:49,secret:{at}:{at + 40}" and (got[100].n_secret, got[100].n_spans) == (2, 2)
    assert all(got[i].n_secret == 1 and got[i].n_email + got[i].n_ip + got[i].n_card + got[i].n_phone == len(brute_base(t)) for i, t in rows[:60])
    assert all(got[i].spans == "" for i in (101, 102, 103))
    masked = {r.doc_id: r.text for r in pii.redact(documents(spark, rows)).collect()}
    assert again not in masked[100].lower() and "[SECRET]" in masked[0] and masked[101] == dict(rows)[101]


def test_long_runs_are_linear():
    text = "1" * 300_000 + " " + "a" * 300_000 + "@" * 1000 + "+" * 1000
    assert pii.base_spans(text) == []
    assert pii.secrets("key" * 100_000 + "=" + "-" * 300_000) == []


# --- WARC ----------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    rows = [(1, "u1", "<p>a"), (2, "u2", "<p>a"), (3, None, ""), (4, "u4", None), (5, "u\n5", "é" * 1000), (0, "u0", "<p>a"), (None, "x", "lone"), (9, "u9", "y" * 200_000)]
    pages = spark.createDataFrame([(*r, "q") for r in rows], "page_id bigint, url string, html string, digest string").repartition(3)
    first = {}
    for i, _, h in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        first.setdefault(h or "", i)
    want = sorted((i, len((h or "").encode()), warc.payload_digest((h or "").encode()), *(("response", None) if first.get(h or "", i) == i else ("revisit", first[h or ""]))) for i, _, h in rows if i is not None)
    got = sorted(tuple(r) for r in warc.round_trip(spark, pages).collect() if r.page_id is not None)
    assert got == want
    assert warc.round_trip(spark, pages.limit(0)).count() == 0


def test_warc_repeated_page_ids(spark):
    # 5: a copy, two rows of a payload of its own; 6: copies of two payloads, one of them twice; 1: its own first copy twice
    rows = [(1, "a"), (1, "a"), (2, "b"), (5, "a"), (5, "own"), (5, "own"), (6, "a"), (6, "b"), (6, "b"), (7, "own"), (None, "lone")]
    first = {"a": 1, "b": 2, "own": 5}
    pages = spark.createDataFrame([(i, f"u{i}", h) for i, h in rows], "page_id bigint, url string, html string").repartition(3)
    got = warc.read(warc.write(pages)).collect()
    want = [(i, warc.payload_digest(h.encode()), first[h] if i is not None and first[h] != i else None) for i, h in rows]
    assert sorted(((r.page_id, r.payload_digest, r.refers_to) for r in got), key=repr) == sorted(want, key=repr)
    assert all((r.type == "response") == (r.refers_to is None) == (r.payload is not None) for r in got)
    assert {bytes(r.payload).decode() for r in got if r.payload is not None} == {h for _, h in rows}


def test_warc_selection_and_ranges(spark):
    pages = spark.createDataFrame([(i, f"u{i}", f"<p>{i}" * 50) for i in range(60)], "page_id bigint, url string, html string").coalesce(1)
    index = warc.write(pages)
    some = index.where("page_id % 7 = 0")
    assert {r.page_id: bytes(r.payload).decode() for r in warc.read(some).collect()} == {i: f"<p>{i}" * 50 for i in range(0, 60, 7)}
    assert warc.ranges(some, max_gap=1 << 20).count() == 1 and warc.ranges(some, max_gap=0).count() == 9
    assert warc.ranges(index, max_range=500).count() > 5


# --- classifier ----------------------------------------------------------------------------------------------------


def test_classifier_learns_and_holds_out(spark):
    rnd = random.Random(3)
    rows = [(i, prose(rnd) if i % 3 else prose(rnd).replace(" ", " | ")) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(400)] + [(None, 1), (5, None), (1, 1)], "doc_id bigint, quality int")
    got = classifier.classify(documents(spark, rows + ODD[:2]), labels).collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([r.predicted == int(r.doc_id % 3 > 0) for r in held if dict(rows).get(r.doc_id)]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)


def test_classifier_without_labels(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert {r.score for r in classifier.classify(documents(spark, ODD), none).collect()} == {0.5}
    assert classifier.classify(documents(spark, ODD).limit(0), none).count() == 0


def test_isotonic_and_tree_sum(spark):
    assert classifier.isotonic(np.array([0, 2, 1, 4]), np.array([2, 2, 2, 4])).tolist() == [0, 0.75, 0.75, 1]
    rows = spark.createDataFrame([(np.array([1.0, i]).tobytes(),) for i in range(50)], "v binary").repartition(7)
    assert classifier.tree_sum(rows, 3).tolist() == [50, 1225]


# --- tokens --------------------------------------------------------------------------------------------------------


ENCODED = [" ", "  ", "\n", "\t", "\xa0", "\x85", "\x1c", "\u3000", "'s", "'", "é", "É", "\u0301", "a", "B", "bc", "12", "!", "Σ", "ΑΣ", "İ", "ß", "中", "😀", "\u200b", "ł", "ª", "'ll", "_"]
ENCODED += ["<|", "|>", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "endoftext", "word", " the", "Zürich", "x" * 33, "\r\n", "\0"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_operators_encode_as_the_unmodified_library(name):
    path, rnd = tokenizer_path(name), random.Random(2)
    plain = Tokenizer.from_file(path)
    texts = ["hello <|endoftext|> world", "<|endoftext|><|endoftext|>", "a<|startoftext|>b", " <|endoftext|>", "", None]
    texts += ["".join(rnd.choice(ENCODED) for _ in range(rnd.randint(0, 20))) for _ in range(4000)]
    texts += ["".join(rnd.choice(ENCODED) for _ in range(20_000)), prose(rnd, 30_000)]
    want = [[*plain.encode(t or "", add_special_tokens=False).ids, token_files.END_ID] for t in texts]
    for text, ids, w in zip(texts, token_files.ids_of(texts, path), want, strict=True):
        assert ids.tolist() == w, repr(text)[:200]
    if name == "byte_bpe_50k.json":
        assert want[0] == [31373, 220, 50256, 995, 0]
    small = tokens.Encoder(path, max_chunks=64, step=16)  # the table is emptied again and again
    ids, at = small.with_end(*textscan.utf8(pa.array(texts[:600], pa.large_string())), token_files.END_ID)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == want[:600]


def test_token_ids_must_fit_their_width(spark):
    with pytest.raises(ValueError, match="fit"):
        token_files.write_shards(documents(spark, [(1, "a")]), tokenizer_path("byte_bpe_50k.json"), width=1)


def test_token_files(spark):
    rnd = random.Random(4)
    rows = [(i, prose(rnd)) for i in range(80)] + [(200, None), (201, ""), (202, "x" * 5000), (203, "dup"), (203, "dup")]
    path = tokenizer_path("byte_bpe_50k.json")
    manifest, dictionary = token_files.write_shards(documents(spark, rows), path)
    got = sorted(map(tuple, token_files.read_shards(spark, manifest, dictionary).collect()), key=lambda r: r[1])
    plain, at, want = Tokenizer.from_file(path), 0, []
    for i, t in sorted(rows, key=lambda r: r[0]):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        want.append((i, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    assert got == want
    shard = token_files.Shard(manifest[0][0], dictionary)
    assert zlib.crc32(shard.ids(0).tobytes()) == want[0][3]
    with pytest.raises(ValueError, match="dictionary"):
        token_files.Shard(manifest[0][0], b"other")
    empty, d = token_files.write_shards(documents(spark, rows).limit(0), path)
    assert token_files.read_shards(spark, empty, d).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 9000), max_size=40))
def test_packing_is_full_and_whole(lengths):
    made, rest = packing.pack([(i, 0, n) for i, n in enumerate(lengths)])
    assert all(sum(p[2] for p in s) == packing.CAPACITY for s in made)
    last = packing.close(rest)
    assert all((n := sum(p[2] for p in s)) & (n - 1) == 0 for s in last) and sum(p[2] for p in rest) < packing.CAPACITY
    cover = defaultdict(list)
    for s in made + last:
        for d, a, n in s:
            cover[d].append((a, n))
    for d, n in enumerate(lengths):
        at = 0
        for a, k in sorted(cover[d]):
            assert a == at and k > 0
            at += k
        assert at == n


def test_packing_balances_cost():
    made, _ = packing.pack([(i, 0, n) for i, n in enumerate([1024] * 8 + [256] * 32)])
    costs = [sum(packing.cost(p[2]) for p in s) for s in made]
    assert max(costs) / min(costs) < 1.05


def test_pack_documents(spark):
    rnd = random.Random(5)
    rows = [(100 + i, prose(rnd, rnd.randint(1, 400))) for i in range(60)] + ODD
    path = tokenizer_path("word_bpe_49k.json")
    got = packing.pack_documents(documents(spark, rows), path).collect()
    plain, by = Tokenizer.from_file(path), defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    for i, t in rows:
        ids, at = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes(), 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) // 4 and r.ids_crc32 == zlib.crc32(ids[4 * at : 4 * (at + r.length)])
            at += r.length
        assert at == len(ids) // 4
    seq = defaultdict(list)
    for r in got:
        seq[r.sequence_id].append((r.offset, r.length))
    for s in seq.values():
        s.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(s, s[1:], strict=False)) and s[0][0] == 0 and sum(n for _, n in s) <= 4096
    assert packing.pack_documents(documents(spark, rows).limit(0), path).count() == 0


# --- substrings ----------------------------------------------------------------------------------------------------


def brute_removed(rows, length=50):
    low, texts = {}, [(i, (t or "").encode()) for i, t in rows]
    for i, b in texts:
        for k in range(len(b) - length + 1):
            if i is not None:
                low[b[k : k + length]] = min(i, low.get(b[k : k + length], i))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if i is not None and low[b[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("alphabet", [["ab", "a", "the ", "é", "x\x00", "\n"], ["a"]])
def test_repeats_are_brute_force(spark, alphabet):
    rnd = random.Random(len(alphabet))
    parts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(10, 120))) for _ in range(10)]
    rows = [(i, None if rnd.random() < 0.05 else "".join(rnd.choice(parts) if rnd.random() < 0.7 else prose(rnd, 6) for _ in range(rnd.randint(0, 6)))) for i in range(80)] + [(None, parts[0] * 2), (7, parts[1])]
    got = substring_dedup.remove_repeats(documents(spark, rows))
    assert sorted(map(tuple, got.collect()), key=repr) == brute_removed(rows)
    assert substring_dedup.remove_repeats(documents(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("memory", [1, 7, 100, 10_000])
def test_disk_queue_and_memory_agree(memory):
    rnd = random.Random(memory)
    body = [prose(rnd, 9).encode()[:40] for _ in range(4)]
    rows = []
    for _ in range(60):
        shift = rnd.randint(0, 26)
        n = rnd.randint(1, shift + 1)
        rows.append((n, shift, (rnd.choice([b"ab", b"a", b"ba"]) * 40)[:shift] + b"#" * 24 + rnd.choice(body) + b"z" * 60))
    n, shift = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    text = np.frombuffer(b"".join(r[2][: r[0] + 49] for r in rows), np.uint8)
    low = np.array([rnd.randrange(50) for _ in rows])
    strings = [{s - o: r[o : o + 50] for o in range(k)} for k, s, r in rows]
    best = substring_dedup.sort_range(text, n, shift, low, memory)
    for i, mine in enumerate(strings):
        for j, x in mine.items():
            assert best[i, j] == min(int(low[k]) for k, other in enumerate(strings) if other.get(j) == x)


# --- HTML ----------------------------------------------------------------------------------------------------------

PAGES = {
    "<ul><li>a<li>b<ol><li>x<li>y</ol><li>c</ul>after": "- a\n- b\n  1. x\n  2. y\n- c\n\nafter",
    "<table><tr><th>Name<th>N<tr><td>long name<td>1<tr><td>x<td>22</table>": "Name       N\nlong name  1\nx          22",
    "<p>one<p>two<br>three<div style='display:none'>no</div><span hidden>no</span>": "one\n\ntwo\nthree",
    "<title>t</title><script>var a='</p>';</script><style>p{}</style>a &amp; <b>b</b>  c<!-- no -->": "a & b c",
    "<pre> a\n  b</pre>z": " a\n  b\n\nz",
    "<ol start=3><li>c<li>d</ol>": "3. c\n4. d",
    "1 < 2 <b": "1 < 2",
    "": "",
}


@pytest.mark.parametrize("page", PAGES)
def test_html_layout(page):
    assert html_text.text_of(page) == PAGES[page]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<li>", "<ul>", "</ul>", "<td>", "<tr>", "<table>", "</table>", "word", " ", "\n", "<b>", "</b>", "<div>", "</div>", "<br>", "<pre>", "</pre>", "<h1>", "</h1>"]), max_size=25).map("".join))
def test_html_keeps_every_visible_word_in_order(page):
    inside_table = "<table>" in page
    assert inside_table or html_text.text_of(page).count("word") == page.count("word")


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("a<table>b<tr>c<td>d</td><p>e</p></tr><center>f</center></table>g", "abc\n\ne\n\nf\n\nd\n\ng"),
        ("<table><form><tr><td>a<td>b</tr></form><tr><form><td>c</form><td>d</table>", "a  b\nc  d"),
        ("<table><colgroup><col><tr><td>a<tbody><div>b<tr><td>c</table>", "b\n\na\nc"),
        ("<table><tr><td>a<table>b<tr><td>c</table>d</table>", "ab\n\nc\n\nd"),
        ("<table><tr><table><tr><td>a</table>b", "a\n\nb"),
    ],
)
def test_html_moves_stray_table_content_out(page, text):
    assert html_text.text_of(page) == text


_TABLE_TAGS = ["<table>", "</table>", "<caption>", "<colgroup>", "<col>", "<tbody>", "<tr>", "</tr>", "<td>", "</td>", "<form>", "</form>", "<center>", "<p>", "</p>", "<div>", "</div>", "<b>", "<li>", "<ul>", "</ul>", "<br>", "word ", " "]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(_TABLE_TAGS), max_size=25))
def test_html_keeps_every_word_of_tables(parts):
    page = "".join(f"w{i}. " if x == "word " else x for i, x in enumerate(parts))
    found, want = re.findall("w[0-9]+[.]", html_text.text_of(page)), re.findall("w[0-9]+[.]", page)
    assert sorted(found) == sorted(want)
    if "<table>" not in parts:
        assert found == want


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<head><title>t</title><p>Hello", "Hello"),
        ("<html><head><meta charset=utf-8>\n<script>x</script><noscript><p>no</p></noscript><h1>a</h1>b", "a\n\nb"),
        ("<head><style>p{}</style> a <b>c</b>", "a c"),
        ("<head>\n<title>t</title></head><body>a", "a"),
        ("<head><svg/>a", "a"),
        ("<div><svg width='1' /><math/>a</div>b", "a\nb"),
    ],
)
def test_html_head_and_self_closing_elements_end(page, text):
    assert html_text.text_of(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p title='A hidden gem in Rome'>a<p data-x=\"overflow hidden auto\">b<p data-style='display:none'>c", "a\n\nb\n\nc"),
        ("<span aria-hidden=true>a</span> <b aria-hidden='true'>b</b>", "a b"),
        ("a<i hidden>b</i><i HIDDEN=''>c</i><i style='color:red; Display : NONE !important;display:block'>d</i>", "a"),
        ("<i style='display:none;display:inline'>a</i><i style=\"background:url('x;display:none')\">b</i><i hidden style=display:inline>c</i>", "abc"),
        ("<div style='visibility:hidden'>a<b style='visibility:visible'>b</b><ul><li>c</ul></div>d", "b\n\nd"),
        ("a<button>b</button>c<select><option>d<option>e</select>f", "a b c\nd\ne\nf"),
        ("<p>a<textarea>\nb &lt;i&gt;\n  c</textarea>d", "a\nb <i>\n  c\nd"),
        ("<dialog>a</dialog><dialog open>b</dialog>c", "b\nc"),
        ("<svg><title>t</title><style/><defs><text>no</text></defs><text>a</text><text>b</text><text display=none>no</text><path/></svg><i display=none></i> <math><mi>x</mi><annotation>no</annotation></math>", "a b x"),
        ("<style style='display:block'>p{}</style><template><b>x</b></template>a", "a"),
    ],
)
def test_html_shows_what_a_reader_sees(page, text):
    assert html_text.text_of(page) == text


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, "<p>a", "x"), (2, None, None), (None, "b", "c")], "page_id bigint, html string, text string")
    assert {r.page_id: r.text for r in html_text.extract(pages).collect()} == {1: "a", 2: None, None: "b"}
    assert html_text.extract(pages.limit(0)).count() == 0
    assert len(html_text.text_of("<div>" * 50_000 + "x" + "</p>" * 10_000)) == 1


# --- store and pipeline --------------------------------------------------------------------------------------------


def test_id_joins_with_and_without_broadcast(spark, monkeypatch):
    docs, ids = documents(spark, ODD), spark.createDataFrame([(4,), (5,)], "doc_id bigint")
    for most in (0, 10):
        monkeypatch.setattr(store, "BROADCAST_IDS", most)
        assert store.only_ids(docs, ids, "doc_id").count() == 2 and store.without_ids(docs, ids, "doc_id").count() == len(ODD) - 2


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(6)
    passage = prose(rnd, 20)
    base = prose(rnd, 150)
    rows = [(i, prose(rnd)) for i in range(40)] + [(50, base), (51, base), (52, base + " more"), (53, prose(rnd) + " " + passage + " " + prose(rnd)), (54, prose(rnd).replace(" ", " | ")), (55, prose(rnd) + " joe@mail.example.com"), (56, None), (57, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left, held = [], spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        held = store.saved(stage(spark, held, str(tmp_path)), "test")
        assert held.columns == docs.columns
        left.append({r.doc_id for r in held.collect()})
    clean = set(range(40))
    assert left == [clean | {50, 51, 52, 53, 55}, clean | {50, 53, 55}, clean | {50, 55}, clean | {50, 55}]
    assert held.where("doc_id = 55").first().text.endswith("[EMAIL]")
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == left[-1]
