"""Token counts, language, leaks, spans, suffixes, archives and near copies on small inputs, against plain Python."""

import hashlib
import inspect
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitalake.llm import decontam, langid, nearcopy, queries, spans, suffix, tokens, vec, warc

CLASH = "doc_id long, text string, n_words string, score string, class_id string, spans string, distance string"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "c", "c", "c", "c", "c") for i, t in rows], CLASH)


def _prose(rng, n, words=400):
    vocabulary = [f"{a}{b}{c}" for a in "bdfgklmn" for b in "aeiou" for c in ("", "r", "st", "ng", "lo", "mi", "ta")]
    out = []
    for i in range(n):
        w = rng.choice(vocabulary[:words])
        out.append(w + (". " if rng.random() < 0.12 else " "))
    return "".join(out).strip() + "."


# --- op1 -------------------------------------------------------------------------------------------------------------

def _greedy(word, pieces):
    symbols = [*word[:-1], word[-1] + tokens.LAST]
    n, i, longest = 0, 0, max(map(len, pieces))
    while i < len(symbols):
        k = next((k for k in range(min(len(symbols), i + longest), i, -1) if tuple(symbols[i:k]) in pieces), None)
        if k is None:
            return 1
        n, i = n + 1, k
    return n


def test_tokens_match_greedy_longest_match(spark):
    rng = random.Random(1)
    pieces = {(b + e,) for b in b"abcd." for e in (0, tokens.LAST)}
    while len(pieces) < 120:
        s = [rng.choice(b"abcd") for _ in range(rng.randint(2, 6))]
        s[-1] += tokens.LAST * (rng.random() < 0.5)
        pieces.add(tuple(s))
    texts = ["".join(rng.choice("aabbccdd. e") for _ in range(rng.randint(0, 300))) for _ in range(60)] + ["", None, " \n ", "ABCD", "a" * 30_000, "éa 12"]
    got = {r["doc_id"]: r for r in tokens.count_tokens(_docs(spark, enumerate(texts)), sorted(pieces)).collect()}
    for i, t in enumerate(texts):
        words = re.findall(rb"[a-z\x80-\xff]+|[0-9]|[^a-z\x80-\xff0-9\s]+", (t or "").lower().encode())
        assert (got[i]["n_words"], got[i]["n_tokens"]) == (len(words), sum(_greedy(w, pieces) for w in words)), t
    assert tokens.count_tokens(_docs(spark, []), sorted(pieces)).count() == 0
    assert tokens.count_tokens(_docs(spark, [(1, "a"), (1, "a"), (None, "a")]), sorted(pieces)).count() == 3


def test_tokens_of_a_real_vocabulary(spark):
    vocabulary = tokens.read_vocabulary(queries.VOCABULARY)
    pieces = set(vocabulary)
    text = "The quick brown fox, naïve, 2024!!"
    row = tokens.count_tokens(_docs(spark, [(1, text)]), vocabulary).first()
    words = re.findall(rb"[a-z\x80-\xff]+|[0-9]|[^a-z\x80-\xff0-9\s]+", text.lower().encode())
    assert row["n_tokens"] == sum(_greedy(w, pieces) for w in words)


# --- op5 -------------------------------------------------------------------------------------------------------------

def test_language_of_known_and_unknown_words(spark):
    rng = random.Random(2)
    sounds = {"xx": ["ka", "ko", "tak"], "yy": ["né", "lé", "mié"]}
    rows = [(i, " ".join("".join(rng.choice(sounds[lang]) for _ in range(rng.randint(1, 4))) for _ in range(60)), lang) for i in range(60) for lang in [("xx", "yy")[i % 2]]]
    docs = spark.createDataFrame(rows + [(900, "zzz", None), (901, None, "xx")], "doc_id long, text string, lang string")
    model = langid.learn(docs, F.lit(True))
    asked = [(1, "takakotakakotakakota"), (2, "miénélémiénélémié"), (3, None), (4, "12 !"), (5, ""), (6, "ka " * 50_000), (6, "ka"), (None, "né"), (7, "鰐")]
    got = langid.identify(_docs(spark, asked), model).collect()
    found = [(r["doc_id"], r["lang_pred"]) for r in got]
    assert found == [(1, "xx"), (2, "yy"), (3, "und"), (4, "und"), (5, "und"), (6, "xx"), (6, "xx"), (None, "yy"), (7, "xx")]
    assert all(0 <= r["score"] <= 1 for r in got)
    assert langid.identify(_docs(spark, []), model).count() == 0
    nothing = langid.learn(docs.limit(0), F.lit(True))
    assert [r["lang_pred"] for r in langid.identify(_docs(spark, asked[:2]), nothing).collect()] == ["und", "und"]


def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.001"
    got = queries.op5_language_id(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right = got.where("lang = lang_pred").count() / got.count()
    assert right > 0.95


# --- op2 -------------------------------------------------------------------------------------------------------------

def _edit(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_bit_parallel_distance():
    rng = random.Random(3)
    for _ in range(300):
        item = [rng.randint(0, 4) for _ in range(rng.randint(1, 30))]
        text = [rng.randint(0, 4) for _ in range(rng.randint(0, 50))]
        assert decontam.best_match(item, text)[0] == min(_edit(item, text), len(item))


def test_leaks_planted_and_clean(spark):
    rng = random.Random(4)
    items = [(k, _prose(rng, rng.randint(12, 60))) for k in range(40)] + [(90, None), (91, ""), (92, "one")]
    rows, want = [], set()
    for i in range(200):
        text = _prose(rng, 300)
        if i % 4 == 0:
            k = rng.randrange(40)
            words = items[k][1].split()
            if i % 8 == 0:
                for _ in range(len(words) // 12):
                    words[rng.randrange(len(words))] = "qqq"
            at = rng.randrange(300)
            text = " ".join([*text.split()[:at], *words, *text.split()[at:]]).upper() if i % 16 == 0 else " ".join([*text.split()[:at], *words, *text.split()[at:]])
            want.add((i, k))
        rows.append((i, text))
    rows += [(500, None), (501, ""), (502, "one " * 30_000)]
    got = decontam.find_leaks(_docs(spark, rows), spark.createDataFrame(items, "item_id int, text string"), items_per_block=15).collect()
    found = {(r["doc_id"], r["item_id"]) for r in got}
    assert found == want | {(502, 92)} | {(r["doc_id"], r["item_id"]) for r in got if r["item_id"] == 92}
    for r in got:
        if r["item_id"] < 90:
            item, text = (re.findall(r"\w+", t.lower()) for t in (items[r["item_id"]][1], rows[r["doc_id"]][1]))
            assert r["distance"] == _edit(item, text)
    assert decontam.find_leaks(_docs(spark, []), spark.createDataFrame(items, "item_id int, text string")).count() == 0
    assert decontam.find_leaks(_docs(spark, rows[:3]), spark.createDataFrame([], "item_id int, text string")).count() == 0


def _edited(rng, words, edits, kind):
    out = list(words)
    for k in range(edits):
        at = rng.randrange(len(out))
        how = kind if kind != "mixed" else rng.choice(["swap", "add", "drop"])
        if how == "add":
            out.insert(at, f"new{k}")
        elif how == "drop":
            del out[at]
        else:
            out[at] = f"new{k}"
    return out


def test_leaks_with_as_many_edits_as_a_match_may_have(spark):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("bdkmnaeiou") for _ in range(6))
    items, rows = [], []
    for n in (3, 5, 9, 15, 16, 24, 30, 31, 59):
        for kind in ("swap", "add", "drop", "mixed"):
            for _ in range(10):
                item = [word() for _ in range(n)]
                around = [[word() for _ in range(rng.randrange(60))] for _ in range(2)]
                rows.append((len(items), " ".join([*around[0], *_edited(rng, item, n // 5, kind), *around[1]])))
                items.append((len(items), " ".join(item)))
    table = spark.createDataFrame(items, "item_id int, text string")
    got = decontam.find_leaks(_docs(spark, rows), table, exact=True).collect()
    found = {r["item_id"]: r["distance"] for r in got if r["doc_id"] == r["item_id"]}
    assert [(i, len(t.split())) for i, t in items if i not in found] == []
    assert all(found[i] <= len(t.split()) // 5 for i, t in items)
    walked = {(r["doc_id"], r["item_id"], r["distance"], r["start_word"]) for r in decontam.find_leaks(_docs(spark, rows), table).collect()}
    assert walked <= {(r["doc_id"], r["item_id"], r["distance"], r["start_word"]) for r in got}


@pytest.mark.parametrize("n", [3, 5, 9, 15, 16, 24, 31, 59, 117, 400])
def test_walks_alone_reach_the_recall(n):
    """Item lengths one by one, so that each is the smallest of its class; a fifth of the words edited."""
    rng = random.Random(n)
    items = [np.array([rng.getrandbits(60) for _ in range(n)], np.uint64) for _ in range(200)]
    texts = []
    for i, item in enumerate(items):
        around = [[rng.getrandbits(60) for _ in range(rng.randrange(60))] for _ in range(2)]
        edited = [w if isinstance(w, int) else rng.getrandbits(60) for w in _edited(rng, item.tolist(), n // 5, ("swap", "add", "drop", "mixed")[i % 4])]
        texts.append([*around[0], *edited, *around[1]])
    hi = np.cumsum([len(t) for t in texts])
    lo = hi - [len(t) for t in texts]
    defaults = {k: p.default for k, p in inspect.signature(decontam.find_leaks).parameters.items()}
    classes = decontam.index(items, defaults["walks"], defaults["samples"], defaults["width"])
    met = decontam._candidates(np.array([w for t in texts for w in t], np.uint64), lo, hi, classes, [])
    found = sum(doc == item for doc, item in {(doc, item) for doc, item, _ in met.tolist()})
    assert found >= 0.95 * len(items)


# --- op3 -------------------------------------------------------------------------------------------------------------

def _brute_spans(rows, least=2, words=15):
    def sentences(text):
        out, at = [], 0
        found = [(m.start(), m.end()) for m in re.finditer(r"\S+", text, re.A)]
        groups = []
        for k, (a, b) in enumerate(found):
            if k == 0 or text[found[k - 1][1] - 1] in ".!?" or "\n" in text[found[k - 1][1]:a]:
                groups.append([])
            groups[-1].append((a, b))
        for g, nxt in zip(groups, [*groups[1:], None], strict=False):
            out.append((text[at if not out else g[0][0]: nxt[0][0] if nxt else len(text)], [text[a:b] for a, b in g]))
        return out

    def runs(s):
        n, out = len(s), set()
        for i in range(n):
            for j in range(i, n):
                if j - i + 1 >= least and sum(len(s[k][1]) for k in range(i, j + 1)) >= words:
                    out.add((i, j))
                    break
            for j in range(i, -1, -1):
                if i - j + 1 >= least and sum(len(s[k][1]) for k in range(j, i + 1)) >= words:
                    out.add((j, i))
                    break
        return sorted(out)

    parsed = {i: sentences(t or "") for i, t in rows}
    spots = {}
    for i in sorted(parsed):
        for a, b in runs(parsed[i]):
            spots.setdefault(tuple(w for k in range(a, b + 1) for w in parsed[i][k][1]), []).append((i, a, b))
    gone = {i: set() for i in parsed}
    for places in spots.values():
        for i, a, b in sorted(places)[1:]:
            gone[i] |= set(range(a, b + 1))
    return {i: (None if t is None else t if not gone[i] else "".join(s for k, (s, _) in enumerate(parsed[i]) if k not in gone[i]).strip(), len(parsed[i]), len(gone[i])) for i, t in rows}


def test_spans_against_brute_force(spark):
    rng = random.Random(5)
    passages = [_prose(rng, rng.randint(15, 80)) for _ in range(6)]
    rows = []
    for i in range(120):
        parts = [_prose(rng, rng.randint(5, 60)) for _ in range(3)]
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            parts.insert(rng.randrange(4), rng.choice(passages))
        rows.append((i, rng.choice([" ", "\n", "  \n "]).join(parts)))
    rows += [(300, rows[7][1]), (301, None), (302, ""), (303, " \n "), (304, "The. Er. The. Er. " * 200)]
    got = {r["doc_id"]: (r["text"], r["n_sentences"], r["n_removed"]) for r in spans.remove_repeated_spans(_docs(spark, rows).withColumn("n_removed", F.lit("clash")), long_sentence=None).collect()}
    want = _brute_spans(rows)
    assert {k: v for k, v in got.items() if v != want[k]} == {}
    assert got[300][0] == "" and sum(v[2] for v in got.values()) > 50
    twice = spans.remove_repeated_spans(_docs(spark, [rows[0], rows[0], (None, rows[0][1])])).collect()
    assert [r["n_removed"] for r in twice] == [0, 0, 0]
    assert spans.remove_repeated_spans(_docs(spark, [])).count() == 0


def test_spans_in_text_without_stop_marks(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("bdkmnaeiou") for _ in range(5))
    passage = " ".join(word() for _ in range(120))
    rows = [(i, f"{' '.join(word() for _ in range(40))} {passage} {' '.join(word() for _ in range(40))}") for i in range(5)] + [(9, "of " * 2000)]
    got = {r["doc_id"]: r["text"].split() for r in spans.remove_repeated_spans(_docs(spark, rows)).collect()}
    assert got[0] == rows[0][1].split() and len(got[9]) <= 150
    middle = passage.split()[30:90]
    for i in range(1, 5):
        own = rows[i][1].split()
        assert not set(middle) & set(got[i]) and set(own[:20]) <= set(got[i]) and set(own[-20:]) <= set(got[i])


def test_no_repeated_run_of_51_words_stays(spark):
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("bdkmnaeiou") for _ in range(6))

    def prose(n):  # sentences of up to 25 words, which are not cut
        out = []
        while len(out) < n:
            out += [word() for _ in range(rng.randint(6, 25))]
            out[-1] += "."
        return out[:n]

    middle = [word() for _ in range(15)] + [word() + "."]
    passages = [prose(n) for n in (51, 51, 52, 60, 75, 120, 300)] + [[word() for _ in range(18)] + [word() + "."] + middle + [word() for _ in range(20)]]
    passages += [[word() for _ in range(22)] + [word() + "."] + [word() for _ in range(24)] + [word() + "."] + [word() for _ in range(22)]]
    rows, own = [], {}
    for i in range(90):
        before, after = prose(rng.randint(20, 90)), prose(rng.randint(20, 90))
        before[-1] = before[-1].rstrip(".")  # the passage starts inside a sentence, and is followed by one's rest
        words = [*before, *passages[i % len(passages)], *after]
        own[i] = {*before, *after}
        rows.append((i, "".join(w + ("\n" if rng.random() < 0.03 else " ") for w in words)))
    got = {r["doc_id"]: r for r in spans.remove_repeated_spans(_docs(spark, rows)).collect()}
    seen, repeated = set(), []
    for i, text in rows:
        words = got[i]["text"].split()
        grams = {tuple(words[k:k + 51]) for k in range(len(words) - 50)}
        repeated += [i] * bool(grams & seen)
        seen |= grams
        assert own[i] <= set(words)
        assert (got[i]["text"] == text) == (i < len(passages)) == (got[i]["n_removed"] == 0)
    assert repeated == []


# --- op4 -------------------------------------------------------------------------------------------------------------

def _brute_suffix(rows, size):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        lost = [False] * len(b)
        for p in range(len(b) - size + 1):
            if b[p:p + size] in seen:
                lost[p:p + size] = [True] * size
            seen.add(b[p:p + size])
        kept = bytes(x for x, y in zip(b, lost, strict=True) if not y)
        spots = [k for k in range(len(b)) if lost[k]]
        out[i] = (len(b), kept, sum(1 for k in spots if k == 0 or not lost[k - 1]), len(spots))
    return out


def test_deep_shallow_order_and_common_prefixes():
    rng = np.random.default_rng(6)
    for width, letters in ((100, 2), (63, 3), (5, 2), (24, 256)):
        m = rng.integers(0, letters, (500, width)).astype(np.uint8)
        m[100:300] = m[rng.integers(0, 5, 200)]
        m[150:300, width // 2:] = rng.integers(0, letters, (150, width - width // 2))
        order, common = suffix.sort_strings(m)
        rows = [m[i].tobytes() for i in order]
        assert rows == sorted(r.tobytes() for r in m)
        assert all(c == next((k for k in range(width) if x[k] != y[k]), width) for x, y, c in zip(rows, rows[1:], common[1:].tolist(), strict=False))


@pytest.mark.parametrize("size", [100, 80, 130])
def test_suffix_removal_against_brute_force(spark, size):
    rng = random.Random(size)
    base = [_prose(rng, 60) for _ in range(12)]
    rows = []
    for i in range(90):
        parts = [rng.choice([rng.choice(base), _prose(rng, 30), "ab" * rng.randint(1, 200), "é" * rng.randint(1, 90)]) for _ in range(rng.randint(1, 5))]
        text = " ".join(parts)
        if rng.random() < 0.5:  # an edit breaks long matches
            p = rng.randrange(len(text))
            text = text[:p] + "#" + text[p + 1:]
        rows.append((i, text))
    rows += [(200, rows[3][1]), (201, rows[3][1]), (-5, rows[4][1]), (202, None), (203, "x" * 99), (204, "x" * 99), (205, "\0" * 300), (206, base[0][:150] + "\0" * 20)]
    got = {r["doc_id"]: (r["n_bytes"], bytes(r["kept"]), len(r["spans"]), sum(s["end"] - s["start"] for s in r["spans"])) for r in suffix.remove_repeats(_docs(spark, rows), min_len=size).collect()}
    want = _brute_suffix(rows, size)
    assert {k: (v[0], v[2:], want[k][0], want[k][2:]) for k, v in got.items() if v != want[k]} == {}
    assert set(got) == set(want)


def test_suffix_odd_rows(spark):
    rows = [(1, "a" * 120), (1, "b" * 130), (1, "b" * 130), (None, "b" * 130), (2, "b" * 130)]
    got = {r["doc_id"]: (r["n_bytes"], len(r["kept"])) for r in suffix.remove_repeats(_docs(spark, rows)).collect()}
    assert got == {1: (130, 1), 2: (130, 0)}
    assert suffix.remove_repeats(_docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        suffix.remove_repeats(_docs(spark, rows), min_len=20)


# --- op7 -------------------------------------------------------------------------------------------------------------

def test_archives_round_trip_and_revisits(spark, tmp_path):
    html = ["<p>a</p>", "<p>b</p>\r\n\r\nWARC/1.1\r\n\r\n", None, "", "é" * 1000, "<p>a</p>", "<p>a</p>", "x" * 300_000]
    rows = [(i, f"http://e/{i}\r\nX: y" if i % 2 else None, h, "clash") for i, h in enumerate(html)] + [(3, "u", "", "clash")]
    pages = spark.createDataFrame(rows, "page_id long, url string, payload string, n string")
    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    warc.write_archives(pages, raw, records_per_file=3)
    back = sorted((r["page_id"], r["payload"]) for r in warc.read_archives(spark, raw).collect())
    assert back == sorted((i, h or "") for i, _, h, _ in rows)
    warc.deduplicate_archives(spark, raw, out)
    got = {(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in warc.read_archives(spark, out).collect()}
    size, digest = (lambda h: len((h or "").encode())), (lambda h: warc.payload_digest((h or "").encode()))
    top = {}
    for i, _, h, _ in rows:
        top[h or ""] = max(i, top.get(h or "", i))
    assert got == {(i, "response" if top[h or ""] == i else "revisit", None if top[h or ""] == i else top[h or ""], size(h), digest(h)) for i, _, h, _ in rows}
    warc.deduplicate_archives(spark, raw, str(tmp_path / "long"), min_bytes=100)
    assert warc.read_archives(spark, str(tmp_path / "long")).where("record_type = 'revisit'").count() == 0
    again = str(tmp_path / "again")
    warc.deduplicate_archives(spark, out, again)  # revisits of earlier archives stay as they are
    assert {(r["page_id"], r["record_type"], r["refers_to"]) for r in warc.read_archives(spark, again).collect()} == {x[:3] for x in got}
    warc.write_archives(pages.limit(0), str(tmp_path / "none"))
    warc.deduplicate_archives(spark, str(tmp_path / "none"), str(tmp_path / "none2"))
    assert warc.read_archives(spark, str(tmp_path / "none2")).count() == 0


# --- op9 -------------------------------------------------------------------------------------------------------------

def test_weighted_samples_estimate_weighted_jaccard():
    rng = np.random.default_rng(7)
    keys = np.sort(rng.integers(0, 1 << 62, 300).astype(np.uint64))
    x, y = rng.uniform(0.5, 8, 300), rng.uniform(0.5, 8, 300)
    marks = [nearcopy.sample(keys, w, np.array([0, 300]), 3000)[0] for w in (x, y)]
    assert (marks[0] == marks[1]).mean() == pytest.approx(np.minimum(x, y).sum() / np.maximum(x, y).sum(), abs=0.03)


def test_near_copies_against_all_pairs(spark):
    rng = random.Random(8)
    rows = []
    for g in range(25):
        words = _prose(rng, 120).split()
        for _ in range(rng.randint(1, 8)):
            copy = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                copy[rng.randrange(len(copy))] = f"z{rng.random()}"
            rows.append((len(rows) * 3, " ".join(copy)))
    rows += [(900, "one two"), (901, "One  TWO\n"), (902, None), (903, ""), (904, " "), (905, "one two three four five six"), (906, "w " * 20_000)]
    got = {r["doc_id"]: r["class_id"] for r in nearcopy.classes(_docs(spark, rows)).collect()}
    texts = [(i, (t or "").lower().encode()) for i, t in rows]
    data = np.frombuffer(b"".join(t for _, t in texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for _, t in texts])])
    keys, counts, at = nearcopy.shingles(data, offsets, 5)
    seen = np.bincount(nearcopy.cell_of(keys), minlength=nearcopy.CELLS)
    idf = np.log1p((np.diff(at) > 0).sum() / np.maximum(seen, 1.0))
    weighed = [(keys[a:b], counts[a:b] * idf[nearcopy.cell_of(keys[a:b])]) for a, b in zip(at, at[1:], strict=False)]
    label = {i: i for i, _ in rows}
    for x in range(len(rows)):
        for y in range(x):
            if nearcopy.similarity(weighed[x], weighed[y]) >= 0.8:
                a, b = label[rows[x][0]], label[rows[y][0]]
                label = {k: min(a, b) if v in (a, b) else v for k, v in label.items()}
    assert got == label and label[901] == 900 and label[903] == 903
    assert nearcopy.classes(_docs(spark, [])).count() == 0
    odd = nearcopy.classes(_docs(spark, [(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, "d"), (None, None)])).collect()
    assert sorted(str(r["class_id"]) for r in odd) == ["1", "1", "1", "2", "None"]


def test_components_of_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 64)] + [(100, 101), (101, 100), (7, 7)], "_a long, _b long")
    got = {r["_v"]: r["_class"] for r in nearcopy.components(links).collect()}
    assert got == {i: 0 for i in range(65)} | {100: 100, 101: 100}


# --- helpers ---------------------------------------------------------------------------------------------------------

def test_words_do_not_cross_documents():
    data = np.frombuffer(b"ab cd" + b"ef" + b"" + b" g", np.uint8)
    starts, ends, hashes = vec.word_hashes(data, np.array([0, 5, 7, 7]))
    assert [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)] == [b"ab", b"cd", b"ef", b"g"]
    assert len(set(hashes.tolist())) == 4


def test_spans_are_made_and_shuffled_once(spark):
    """The smallest id per hash and the rows it was joined to each cut the texts into spans again."""
    docs = spark.createDataFrame([(i, f"One two three four five six seven eight {i % 3}. Nine ten eleven twelve thirteen fourteen fifteen {i % 2}.") for i in range(9)], "doc_id long, text string")
    plan = spans.remove_repeated_spans(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2  # the spans, and the texts without them
