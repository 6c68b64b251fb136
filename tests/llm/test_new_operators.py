"""Divergence audit, lexical search and license scans on small inputs, against plain Python."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from vitalake.llm import bytewords, divergence, lexical, licenses, spans

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _texts(rng, n, words):
    return [rng.choice([" ", ", ", "\n", "-", "\x1f"]).join(rng.choice(words) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_byte_words():
    text = "Ärger İst da_x 9Z\x1fq\x0b" + "é" * 50
    for table, pattern in ((bytewords.LETTERS, LETTERS), (bytewords.ALPHANUMERIC, TERMS)):
        for piece in (1, 7, 1 << 20):
            got = [w.decode() for part in bytewords.words(text.encode(), table, piece) for w in part]
            assert got == pattern.findall(text.translate(UPPER))
    assert list(bytewords.words(b"", bytewords.LETTERS)) == []


# --- op11 ------------------------------------------------------------------------------------------------------------

def _audit(rows, min_docs, top):
    """Every group against every kept term, as the definition says."""
    groups, seen = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = LETTERS.findall((text or "").translate(UPPER))
        groups[lang or "", source or ""].update(terms)
        seen[lang or ""].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in seen[lang].items() if n >= min_docs)
        sources = sorted(s for x, s in groups if x == lang)
        whole = sum((groups[lang, s] for s in sources), Counter())

        def rates(counts):
            total = sum(counts[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // total for t in kept}

        by_source, q = {s: rates(groups[lang, s]) for s in sources}, rates(whole)
        for s in sources:
            p = by_source[s]
            pairs = [(o, sum((p[t] - by_source[o][t]) ** 2 // by_source[o][t] for t in kept)) for o in sources if o != s]
            terms = [(t, (p[t] - q[t]) ** 2 // q[t]) for t in kept if groups[lang, s][t] and p[t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)]
    return sorted(out)


def test_divergence_matches_definition(spark):
    rng = random.Random(11)
    words = [a + b for a in ("ka", "Lo", "mé", "zz", "ñ") for b in ("", "ri", "TA", "ön", "s")]
    rows = [(t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None, "é"])) for t in _texts(rng, 120, words)]
    rows += [(None, "en", "a"), ("", "fr", "only"), ("", "fr", "other"), ("once", "it", "x"), ("ka ka", "en", "hot")] + [("LO lo", "de", "a")] * 5
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "text string, lang string, source string, term string, n long")
    for held in (5, 200_000):
        counts = divergence.term_counts(docs, held=held)
        assert counts.where(F.col("term") == "lo").agg(F.sum("n")).first()[0] == sum(LETTERS.findall((r[0] or "").translate(UPPER)).count("lo") for r in rows)
    got = sorted(tuple(r) for r in divergence.audit(docs, top=7).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == _audit(rows, 3, 7)
    assert divergence.audit(docs.limit(0)).count() == 0


def test_divergence_of_very_large_counts(spark):
    rate = divergence._rate(F.lit(9 * 10**17), F.lit(10**18))
    assert spark.range(1).select(rate.alias("p")).first()["p"] == 1 + 9 * 10**8


# --- op12 ------------------------------------------------------------------------------------------------------------

def _search(docs, items, k):
    terms = [(i, TERMS.findall((t or "").translate(UPPER))) for i, t in docs]
    terms = [(i, Counter(t), len(t)) for i, t in terms if t]
    n, total = len(terms), sum(x[2] for x in terms)
    df = Counter(t for _, c, _ in terms for t in c)
    out = []
    for item, text in items:
        asked = TERMS.findall((text or "").translate(UPPER))
        scores = []
        for i, counts, size in terms:
            m = 100 - 25 + 25 * size * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * counts[t] // (1000 * counts[t] + 12 * m)) for t in asked if t in counts)
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("k,block_bytes,block_postings", [(20, 1 << 20, 1 << 20), (3, 1000, 30)])
def test_search_matches_definition(spark, k, block_bytes, block_postings):
    rng = random.Random(k)
    words = [a + b for a in ("ka", "Lo", "mé", "z9", "ñ", "the") for b in ("", "ri", "TA", "ön", "7")]
    docs = list(enumerate(_texts(rng, 150, words))) + [(900 + i, "ka lo ka") for i in range(30)] + [(950, None), (951, ""), (952, "..."), (None, "ka mé"), (953, "the " * 5000)]
    items = list(enumerate(_texts(rng, 12, words))) + [(50, "ka KA lo"), (51, None), (52, "absent"), (53, "the")]
    frame = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in docs], "doc_id long, text string, terms string, n long, rank int").repartition(5)
    asked = spark.createDataFrame([*items, items[0]], "item_id long, text string")
    got = lexical.search(frame, asked, k=k, block_bytes=block_bytes, block_postings=block_postings)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == _search(docs, items, k)


def test_search_of_nothing_and_text_ids(spark):
    docs = spark.createDataFrame([("b", "one two"), ("a", "one two"), ("c", "three")], "doc_id string, text string")
    items = spark.createDataFrame([("q", "two")], "item_id string, text string")
    assert [(r["rank"], r["doc_id"]) for r in lexical.search(docs, items).orderBy("rank").collect()] == [(1, "a"), (2, "b")]
    assert lexical.search(docs.limit(0), items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0


# --- op13 ------------------------------------------------------------------------------------------------------------

MARKS = re.compile(r"<<(.*?)>>", re.S)


def _pattern(template):
    """The template as a regular expression over words that end with a space."""
    out = []
    for i, piece in enumerate(MARKS.split(template.markup)):
        if i % 2 == 0:
            out += [re.escape(w) + " " for w in TERMS.findall(piece.translate(UPPER))]
        else:
            out.append({"beginOptional": "(?:", "endOptional": ")?"}.get(piece) or r"(?:\S+ ){0,%s}" % piece.split("max=")[1])
    return re.compile("".join(out))


def _scan(text, templates):
    words = TERMS.findall((text or "").translate(UPPER))
    patterns = [_pattern(t) for t in templates]
    out = []
    for start in range(len(words)):
        rest = "".join(w + " " for w in words[start:])
        for t, pattern in zip(templates, patterns):
            if pattern.match(rest):
                ends = [e for e in range(start + 1, len(words) + 1) if pattern.fullmatch("".join(w + " " for w in words[start:e]))]
                out.append((t.label, t.base, start, max(ends)))
    return len(words), sorted(out)


def _rendered(rng, template):
    """A text of the template: optional regions kept or left out, replaceable ones filled."""
    out, skip = [], 0
    for i, piece in enumerate(MARKS.split(template.markup)):
        if i % 2 == 0:
            out += [] if skip else piece.split(" ")
        elif piece == "beginOptional":
            skip += bool(skip or rng.random() < 0.5)
        elif piece == "endOptional":
            skip -= bool(skip)
        elif not skip:
            out += ["filler"] * rng.randint(0, int(piece.split("max=")[1]))
    return " ".join(x.upper() if rng.random() < 0.1 else x for x in out)


def test_licenses_match_definition(spark):
    rng = random.Random(13)
    short = licenses.BASE + (
        licenses.Template("nested", "use <<beginOptional>>it <<beginOptional>>as<<endOptional>> is<<endOptional>> freely"),
        licenses.Template("gap", "made by <<var;max=3>> for all"),
        licenses.Template("led", "<<beginOptional>>this<<endOptional>> work <<beginOptional>>work<<endOptional>> ends"),
    )
    words = "use it as is freely made by for all this work ends under the mit license apache version 2 cc nc x".split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(80)]
    texts += [_rendered(rng, t) for t in short * 3] + [None, "", "...", "CC-BY-NC", "under\nTHE (mit) License", "made by made by for all for all", "under the ünder the MIT licenseé"]
    docs = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in enumerate(texts)], "doc_id long, text string, matches string, labels string, n_words long")
    for r in licenses.scan(docs, short).collect():
        n, want = _scan(texts[r["doc_id"]], short)
        assert (r["n_words"], sorted(tuple(m) for m in r["matches"])) == (n, want), texts[r["doc_id"]]
        assert r["n_covered"] == len({w for _, _, s, e in want for w in range(s, e)})


def test_license_wordings_and_digest(spark):
    rng = random.Random(14)
    texts = [f"Before. {_rendered(rng, t)} after" for t in licenses.OWN for _ in range(4)]
    texts += [t.replace("Permission", "Permission never") for t in texts if "Permission" in t]
    texts += [None, "Licensed under CC BY-NC 4.0.", "Released under the MIT License. Again under the MIT license", "Licensed under the Apache License, Version 2.0.",
              "This work is licensed under the GNU General Public License, version 3."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.digest(licenses.scan(docs)).collect()}
    for i, text in enumerate(texts):
        n, want = _scan(text, licenses.TEMPLATES)
        base = [m for m in want if m[1]]
        starts = [m[2] for m in base]
        covered = len({w for _, _, s, e in want for w in range(s, e)})
        assert tuple(got[i])[1:7] == (
            n, len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({m[0] for m in base})), ",".join(sorted({m[0] for m in want}))), text
        assert got[i]["score"] == pytest.approx(covered / n if n else 0)
    assert all(got[i * 4 + j]["labels"].split(",").count(t.label) for i, t in enumerate(licenses.OWN) for j in range(4))
    tail = [got[i]["labels"] for i in range(len(texts) - 4, len(texts))]
    assert tail == ["cc-by-nc,cc-by-nc-4", "mit", "apache-2,apache-2-name", "gpl-3"]
    assert licenses.digest(licenses.scan(docs.limit(0))).count() == 0


@pytest.mark.parametrize("markup", ["<<var;max=3>> license", "<<beginOptional>>all<<endOptional>>", "a <<beginOptional>>b", "a <<endOptional>>", "a <<what>> b", ""])
def test_bad_templates_are_refused(markup):
    with pytest.raises(ValueError):
        licenses.compile_templates([licenses.Template("bad", markup)])


# --- op3 -------------------------------------------------------------------------------------------------------------

def test_spans_keep_columns_of_any_name(spark):
    passage = "The quick brown fox jumps over the lazy dog today. Nobody in the whole wide town had ever seen it before that. "
    rows = [(1, passage + "One ends here.", *"abcdefg"), (2, passage + "Two ends there.", *"hijklmn"), (None, passage, *"opqrstu")]
    names = ["_id", "_gone", "_h", "_t", "_first", "_span", "_span_id"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    got = {r["doc_id"]: r for r in spans.remove_repeated_spans(docs).collect()}
    assert [got[i]["text"] for i in (1, 2, None)] == [passage + "One ends here.", "Two ends there.", passage]
    assert [got[2][n] for n in names] == list("hijklmn") and got[2]["n_removed"] == 2
