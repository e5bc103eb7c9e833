"""Exact and near copies, passages, languages, resampling and mixing against brute force."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from shipgauge.llm import near_dup
from shipgauge.llm.exact_dup import drop_exact_duplicates, exact_duplicates
from shipgauge.llm.language import keep_known_languages, language_id, learn
from shipgauge.llm.language import _scores as code_lengths
from shipgauge.llm.mixing import domain_labels, mix, mixing_rates
from shipgauge.llm.passages import drop_passages, repeated_passages, text_units
from shipgauge.llm.resampling import features, kth_largest, resample
from shipgauge.llm.words import word_hashes
from tests.llm.util import awkward, clashing, docs, sentence

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture
def case_sensitive(spark):
    spark.conf.set("spark.sql.caseSensitive", "true")
    yield
    spark.conf.unset("spark.sql.caseSensitive")


# ---- exact copies

def brute_exact(rows):
    groups = defaultdict(list)
    for i, (d, t, *_) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), d is None, d or 0, i, d))
    out = []
    for plain, own in groups.items():
        best = min(own)
        for r in own:
            out.append((r[4], best[4], len(own), hashlib.sha256(plain.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("fan_in, rounds", [(16, 2), (2, 3), (3, 1)])
def test_exact_duplicates(spark, fan_in, rounds):
    rnd = random.Random(2)
    rows = awkward() + [(100 + i, " ".join(rnd.choice(("ab", "c", "é\n")) for _ in range(rnd.randrange(4)))) for i in range(300)]
    got = exact_duplicates(docs(spark, rows).repartition(5), fan_in, rounds).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == Counter(brute_exact(rows))
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter({h: 1 for h in {r.text_sha256 for r in got}})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_drop_exact_duplicates(spark, case_sensitive):
    rows = awkward()
    kept = drop_exact_duplicates(clashing(spark, rows))
    assert kept.columns == clashing(spark, rows).columns
    want = {re.sub(r"\s", "", t or "") for _, t, *_ in rows if "\x1c" not in (t or "")}
    assert len({r.text for r in kept.collect()}) == kept.count() == len(want) + 1
    assert drop_exact_duplicates(docs(spark, [])).collect() == exact_duplicates(docs(spark, [])).collect() == []


# ---- near copies

def full_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j - 1] + (x != y), last[j] + 1, row[-1] + 1))
    return row[-1]


def test_edits_within():
    r = np.random.default_rng(1)
    for t in range(400):
        a = r.integers(0, 4, r.integers(0, 25)).astype(np.uint32)
        b = a.copy() if t % 2 else r.integers(0, 4, r.integers(0, 25)).astype(np.uint32)
        for _ in range(r.integers(0, 5)):
            b = np.insert(b, r.integers(len(b) + 1), 9) if r.random() < 0.5 or not len(b) else np.delete(b, r.integers(len(b)))
        limit = int(r.integers(0, 25))
        want = full_distance(a, b) if full_distance(a, b) <= limit else None
        assert near_dup.edits_within(a, b, limit) == want
        if abs(len(a) - len(b)) <= limit:
            assert near_dup._band(a, b, limit) == want
        assert near_dup._script(a, b) >= full_distance(a, b)
        assert near_dup.similar(a, b, 0.8) == (full_distance(a, b) <= math.floor(0.2 * max(len(a), len(b)) + 1e-9))


def test_long_texts_and_wide_bands(monkeypatch):
    r = np.random.default_rng(2)
    monkeypatch.setattr(near_dup, "BAND_BITS", 200)  # wider bands go by rows of numbers
    monkeypatch.setattr(near_dup, "LONG", 10)
    for t in range(200):
        a = r.integers(0, 4, r.integers(0, 25)).astype(np.uint32)
        b = np.delete(a, r.integers(len(a))) if t % 2 and len(a) else r.integers(0, 4, r.integers(0, 25)).astype(np.uint32)
        limit = int(r.integers(0, 25))
        want = full_distance(a, b)
        assert near_dup.edits_within(a, b, limit) == (want if want <= limit else None)
        assert near_dup._aligned(a, b, limit) == (want <= limit)


def test_sketches_keep_order_and_occurrences():
    words = np.arange(1, 9, dtype=np.uint64)
    same = lambda a, b: bool((near_dup.sketch(a, 1, 8, 4) == near_dup.sketch(b, 1, 8, 4)).any())
    assert same(words, words) and not same(words, words[::-1].copy())
    assert not same(np.array([1, 1, 2], np.uint64), np.array([1, 2, 2], np.uint64))


def brute_classes(rows, similarity=0.8):
    words = [(t or "").lower().split() for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = words[i], words[j]
        longer = max(len(a), len(b))
        if abs(len(a) - len(b)) <= 0.2 * longer and full_distance(a, b) <= math.floor((1 - similarity) * longer + 1e-9):
            root[find(j)] = find(i)
    return Counter(frozenset(rows[k][0] for k in range(len(rows)) if find(k) == i) for i in range(len(rows)) if find(i) == i)


def near_rows():
    rnd, rows = random.Random(7), []
    passage = sentence(rnd, 12)
    for g in range(14):
        base = sentence(rnd, rnd.choice((4, 30, 60, 90)), 5000).split()
        for c in range(rnd.choice((1, 1, 2, 5))):
            own = base.copy()
            if c and len(own) > 20:
                own[rnd.randrange(len(own))] = f"edit{c}"
            rows.append((len(rows), " ".join(own)))
    # Copies in plenty of one, and documents that share a passage and nothing else.
    base = sentence(rnd, 60, 5000)
    rows += [(len(rows) + i, f"{base} tail{i % 3}") for i in range(12)]
    rows += [(len(rows) + i, f"{sentence(rnd, 9, 5000)} {passage} {sentence(rnd, 9, 5000)}") for i in range(8)]
    return [*rows, (900, None), (901, ""), (902, " \n "), (903, "short"), (904, "SHORT"), (905, rows[0][1]), (905, rows[0][1])]


@pytest.mark.parametrize("block", [3, 256])
def test_near_duplicates(spark, block, monkeypatch):
    monkeypatch.setattr(near_dup.linked_roots, "__defaults__", (0.8, block))
    rows = near_rows()
    got = near_dup.near_duplicates(docs(spark, rows).repartition(4)).collect()
    classes = defaultdict(set)
    for r in got:
        classes[r.class_id].add(r.doc_id)
    assert len(got) == len(rows)
    assert set(map(frozenset, classes.values())) == set(brute_classes(rows))
    assert all(k == min(v) for k, v in classes.items())
    assert Counter(r.class_id for r in got if r.kept) == Counter(dict.fromkeys(classes, 1))
    assert all(r.class_size == sum(x.class_id == r.class_id for x in got) for r in got)


def test_left_over_nodes_meet_their_whole_bucket(spark):
    """A bucket of unrelated groups: all links are found although one star cannot hold them."""
    rnd = random.Random(9)
    bases = [np.array([rnd.randrange(1 << 30) for _ in range(40)], "<u4") for _ in range(5)]
    nodes, of = [], []
    for i in range(30):
        words = bases[i % 5].copy()
        words[rnd.randrange(40)] = i
        nodes.append((i, [77, 1000 + i], words.tobytes()))
        of.append(i % 5)
    df = spark.createDataFrame(nodes, "row long, sketches array<long>, words binary")
    for block in (4, 256):
        roots = {r.node: r.root for r in near_dup.linked_roots(df.drop("words"), df.drop("sketches"), 0.8, block).collect()}
        assert roots == {i: of[i] for i in range(30)}


def test_components(spark):
    rnd = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(100 + rnd.randrange(40), 100 + rnd.randrange(40)) for _ in range(30)] + [(200, 200 + i) for i in range(1, 20)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.node: r.root for r in near_dup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for e in edges for n in e if e[0] != e[1]}


def test_drop_near_duplicates(spark, case_sensitive):
    rows = near_rows()
    kept = near_dup.drop_near_duplicates(clashing(spark, rows))
    assert len(kept.columns) == 12 and kept.count() == len(brute_classes(rows))
    assert near_dup.drop_near_duplicates(docs(spark, [])).collect() == near_dup.near_duplicates(docs(spark, [])).collect() == []
    assert near_dup.near_duplicates(docs(spark, awkward())).count() == len(awkward())


@pytest.mark.parametrize("similarity, rate", [(0.8, 0.9), (0.85, 0.97), (0.9, 0.99)])
def test_links_down_to_the_similarity_are_found(spark, similarity, rate):
    rnd, rows = random.Random(11), []
    for i in range(150):
        own = [f"w{rnd.randrange(10**9)}" for _ in range((50, 100, 400)[i % 3])]
        other = own.copy()
        for k in rnd.sample(range(len(own)), math.floor((1 - similarity) * len(own) + 1e-9)):
            other[k] = f"edit{k}"
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join(other))]
    got = {r.doc_id: (r.class_id, r.class_size) for r in near_dup.near_duplicates(docs(spark, rows)).collect()}
    assert all(c // 2 == d // 2 for d, (c, _) in got.items())
    assert sum(got[2 * i + 1] == (2 * i, 2) for i in range(150)) >= rate * 150


# ---- passages

@pytest.mark.parametrize("text", ["", " \n\t", "one", "a b\nc", "\n a  b\x0b c \n\n\x1c d\x85e\u2003f \n", "x\r\ny z\r\n", "İ Σ\nß\u3000\nend "])
def test_words_before_a_line_are_those_of_the_lines_before(text):
    from shipgauge.llm.passages import text_lines

    before = 0
    for begin, _, words, _ in text_lines(text):
        assert len(text[:begin].split()) == before
        before += words
    assert len(text.split()) == before


def brute_passages(rows, run_words):
    first, found = {}, []
    ranked = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    for i in ranked:
        for a, _, _, plain in text_units(rows[i][1] or ""):
            first.setdefault(plain, (i, a))
    for i, (d, t, *_) in enumerate(rows):
        run = []
        for a, b, n, plain in [*text_units(t or ""), (None, None, 0, None)]:
            if plain is not None and first[plain] != (i, a):
                run.append((a, b, n))
                continue
            if run and sum(x[2] for x in run) >= run_words:
                found.append((d, run[0][0], run[-1][1], len(run), sum(x[2] for x in run)))
            run = []
    return Counter(found)


def test_units_have_their_offsets():
    text = "One two three. Four five\nsix.  Seven eight nine ten!? \n\n x"
    assert [(text[a:b], n) for a, b, n, _ in text_units(text)] == [("One two three.", 3), ("Seven eight nine ten!?", 4)]


def test_repeated_passages(spark):
    rnd = random.Random(3)
    shared = [". ".join(sentence(rnd, 9, 9000) for _ in range(7)) + "." for _ in range(3)]
    rows = [(i, f"{sentence(rnd, 20, 9000)}. {shared[i % 3]} {sentence(rnd, 12, 9000)}.\n{sentence(rnd, 8, 9000)}") for i in range(12)]
    rows += [(50 + i, f"{sentence(rnd, 20, 9000)}.\nAll rights are reserved here.") for i in range(5)]  # short repeats stay
    rows += [(60, f"{shared[0].upper()} {shared[0]}"), (None, shared[1]), (61, rows[0][1]), (61, rows[0][1]), *awkward()]
    got = repeated_passages(docs(spark, rows).coalesce(1)).collect()
    assert Counter((r.doc_id, r.begin, r.finish, r.units, r.words) for r in got) == brute_passages(rows, 30)
    flagged = {r.doc_id for r in got}
    assert set(range(3, 12)) <= flagged and not flagged & {0, 1, 2, *range(50, 55)}
    assert {r.first_doc_id for r in got if r.doc_id == 4} == {1}


def test_repeated_lines(spark):
    """Lines as units: every one that has come before goes, also single words; the 17-word line of 300 documents stays once."""
    rnd = random.Random(4)
    line = sentence(rnd, 17, 9000)
    rows = [(i, f"{sentence(rnd, 9, 9000)}\n  {line.upper() if i % 2 else line} \n\nEnd {i}\nok") for i in range(300)]
    rows += [(None, f"{line}\n\t\n"), (400, None), (401, "\n \n"), (402, "ok"), (402, "ok")]
    got = repeated_passages(docs(spark, rows).coalesce(1), run_words=1, lines=True).collect()
    seen, want = set(), {}
    for n, (d, text) in enumerate(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))):
        for m in re.finditer(r"\S(?:[^\n]*\S)?", text or ""):
            plain = " ".join(m.group().lower().split())
            if plain in seen:
                want.setdefault(n, []).append((d, m.start(), m.end()))
            seen.add(plain)
    flat = [x for spans in want.values() for x in spans]
    assert sum(r.units for r in got) == len(flat) and sum(r.words for r in got) == 17 * 300 + 299 + 2
    covered = Counter((d, i) for d, a, b in flat for i in range(a, b))
    mine = Counter((r.doc_id, i) for r in got for i in range(r.begin, r.finish))
    assert set(covered) <= set(mine) and all(mine[k] == v for k, v in covered.items())
    kept = {r.doc_id: r.text for r in drop_passages(docs(spark, rows), run_words=1, lines=True).collect()}
    assert line in kept[0] and all(line not in kept[i].lower() for i in range(1, 300)) and "End 7" in kept[7]


def test_passages_that_begin_and_end_within_sentences(spark):
    """Every window of 50 words that has occurred before goes, against brute force, and nothing else."""
    rnd = random.Random(13)
    shared = sentence(rnd, 54, 9000), sentence(rnd, 155, 9000), sentence(rnd, 49, 9000)
    rows = []
    for i in range(18):
        own = [sentence(rnd, 7, 9000), sentence(rnd, 33, 9000), sentence(rnd, 3, 9000), sentence(rnd, 5, 9000)]
        rows.append((i, f"{own[0]}. {own[1]} {shared[i % 3]}\n{own[2]} {own[3]}."))
    # Lines of two words, a line end in another place, a loop of 30 words, an id that is null.
    lines = "\n".join(f"a{i} b{i}" for i in range(40))
    loop = sentence(rnd, 30, 9000)
    rows += [(30, f"x1 {lines}\ny1 z1"), (31, f"x2 {lines}\ny2 z2"), (32, shared[1].upper().replace(" ", " \n", 3)), (33, " ".join([loop] * 5)), (None, shared[0])]
    first, want = {}, {}
    for d, text in rows:  # in the order of their ids
        words = [(w.lower().rstrip(".!?"), m.span()) for m in re.finditer(r"\S+", text) for w in [m.group()]]
        gone = set()
        for k in range(len(words) - 49):
            if first.setdefault(tuple(w for w, _ in words[k:k + 50]), (d, k)) != (d, k):
                gone.update(range(k, k + 50))
        if gone:
            assert len(gone) == max(gone) - min(gone) + 1
            want[d] = (words[min(gone)][1][0], words[max(gone)][1][1], len(gone))
    got = repeated_passages(docs(spark, rows).repartition(3)).collect()
    assert {r.doc_id: (r.begin, r.finish, r.words) for r in got} == want and len(got) == len(want)
    assert set(want) == {i for i in range(3, 18) if i % 3 < 2} | {31, 32, 33, None}
    assert {r.first_doc_id for r in got if r.doc_id in (4, 32)} == {1}


def test_drop_passages(spark, case_sensitive):
    rnd = random.Random(5)
    shared = ". ".join(sentence(rnd, 9, 9000) for _ in range(7)) + "."
    rows = [(1, f"Intro é one two three. {shared} End of it."), (2, f"日本 another start here. {shared} The other end."), (3, None)]
    got = {r.doc_id: r.text for r in drop_passages(clashing(spark, rows)).collect()}
    assert got == {1: rows[0][1], 2: "日本 another start here.  The other end.", 3: None}
    assert drop_passages(docs(spark, [])).collect() == repeated_passages(docs(spark, [])).collect() == []


# ---- languages

PHRASES = {"en": "the cat and the dog of this house with them ", "de": "der Hund und die Katze für das schöne Haus ", "fr": "le chien et la maison où être avec les élèves "}


def language_rows(n=120):
    rnd, rows = random.Random(1), []
    for i in range(n):
        lang = rnd.choice(list(PHRASES))
        w = PHRASES[lang].split()
        rows.append((i, " ".join(rnd.choice(w) for _ in range(rnd.randrange(3, 40))), lang))
    return rows


def brute_ppm(model_rows, order, text):
    """Code lengths straight from the definition."""
    out = {}
    for lang in sorted({x for x, _ in model_rows}):
        seen = defaultdict(Counter)
        for own, t in model_rows:
            if own == lang:
                b = t.encode()
                for i in range(len(b)):
                    for k in range(min(i, order) + 1):
                        seen[k, b[i - k:i]][b[i]] += 1
        bits, b = 0.0, text.encode()
        for i in range(len(b)):
            for k in range(min(i, order), -1, -1):
                c = seen.get((k, b[i - k:i]))
                if c and b[i] in c:
                    bits -= math.log2(c[b[i]] / (sum(c.values()) + len(c)))
                    break
                if c:
                    bits -= math.log2(len(c) / (sum(c.values()) + len(c)))
            else:
                bits += 8
        out[lang] = bits
    return out


def test_code_lengths(spark):
    rows = [(lang, t) for _, t, lang in language_rows(12)]
    model = learn(spark.createDataFrame(rows, "lang string, text string").repartition(3), order=3)
    texts = ["the dog", "élève über", "", "x", "日本 and", rows[0][1], "zz\x00"]
    got = code_lengths(model, pa.array(texts))
    for text, bits in zip(texts, got):
        assert dict(zip(model.langs, bits)) == pytest.approx(brute_ppm(rows, 3, text))


def test_language_id(spark):
    rows = language_rows() + [(500, None, "en"), (501, "12 !?", "de"), (502, "", None), (None, "der Hund und", None), (503, "le chien et la maison", None)]
    got = {r.doc_id: r for r in language_id(docs(spark, rows)).collect()}
    import zlib

    for d, t, lang in rows[:-5]:
        assert got[d].held_out == (zlib.crc32(str(d).encode()) % 3 == 1)
        assert got[d].lang_pred == lang and 0.5 < got[d].score <= 1
    assert [got[d].lang_pred for d in (500, 501, 502, None, 503)] == ["und", "und", "und", "de", "fr"]
    assert got[500].score == 0 and got[None].held_out is False


def test_language_does_not_look_at_lang_of_held_out_rows(spark):
    rows = language_rows()
    base = {r.doc_id: (r.lang_pred, r.score) for r in language_id(docs(spark, rows)).collect()}
    held = {r.doc_id for r in language_id(docs(spark, rows)).where("held_out").collect()}
    changed = [(d, t, "xx" if d in held else lang) for d, t, lang in rows]
    assert {r.doc_id: (r.lang_pred, r.score) for r in language_id(docs(spark, changed)).collect()} == base


def test_training_rows_of_repeats(spark):
    """One id 300 times, with one text or with several, gives no more rows than asked for."""
    rows = [(2, "one text", "en")] * 300 + [(3, f"text {i}", "en") for i in range(300)] + [(4, "ein Text", "de")]
    from shipgauge.llm.language import training_rows
    got = Counter(r.lang for r in training_rows(docs(spark, rows), 20).collect())
    assert got["en"] <= 20 and sum(got.values()) == len({(r.lang, r.text) for r in training_rows(docs(spark, rows), 20).collect()})


def test_no_language_to_learn_from(spark):
    rows = [(1, "some words", None), (2, "more", None), (3, "12 !", None), (4, None, None)]
    assert {r.doc_id for r in keep_known_languages(docs(spark, rows)).collect()} == {1, 2}
    upper = docs(spark, rows).toDF("DOC_ID", "TEXT", "LANG", "source", "n_chars")
    assert keep_known_languages(upper).count() == 2 and keep_known_languages(upper).columns[2] == "LANG"


def test_keep_known_languages(spark, case_sensitive):
    rows = language_rows()
    junk = [(700, "\x01\x02\x7f" * 40 + "q", None), (701, "123", None), (702, None, None), (703, "der Hund und", None)]
    kept = keep_known_languages(docs(spark, rows + junk))
    got = {r.doc_id: r.lang for r in kept.collect()}
    assert set(got) == {d for d, *_ in rows} | {703} and got[703] == "de"
    assert keep_known_languages(clashing(spark, awkward())).columns == clashing(spark, []).columns
    assert keep_known_languages(docs(spark, [])).collect() == language_id(docs(spark, [])).collect() == []
    assert {r.lang_pred for r in language_id(docs(spark, [(1, "no language known")])).collect()} == {"und"}


# ---- resampling and mixing

def labelled(n=240):
    rnd, rows, labels = random.Random(6), [], []
    for i in range(n):
        kind = i % 4
        words = sentence(rnd, rnd.randrange(20, 60), 60).split()
        if kind == 0:
            words = [w + "***" for w in words]
        if kind == 1:
            words[::5] = ["nasty"] * len(words[::5])
        if kind > 1:
            words[::5] = ["kind"] * len(words[::5])
        rows.append((i, " ".join(words)))
        if i % 3:
            labels.append((i, int(kind != 0), int(kind == 1)))
    return rows, labels


def test_resample(spark):
    rows, labels = labelled()
    sample = resample(docs(spark, rows), spark.createDataFrame(labels, LABELS), fraction=0.5).collect()
    assert len(sample) == 120 and all(r.kept for r in sample)
    assert Counter(r.doc_id % 4 in (2, 3) for r in sample)[True] >= 115
    # The weights from their definition.
    buckets = 1 << 17
    good = {d for d, q, t in labels if q and not t}
    per_doc = [features(pa.array([t]), buckets)[0] for _, t in rows]
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for (d, _), values in zip(rows, per_doc):
        np.add.at(raw, values, 1)
        if d in good:
            np.add.at(target, values, 1)
    ratio = np.log((target + 100) / (raw / raw.sum() * target.sum() + 100))
    for r in sample:
        assert r.log_weight == pytest.approx(ratio[per_doc[r.doc_id]].sum())
    again = resample(docs(spark, rows).repartition(7), spark.createDataFrame(labels, LABELS), fraction=0.5).collect()
    assert {r.doc_id for r in again} == {r.doc_id for r in sample}


def test_the_sample_is_as_large_as_the_labelled_good_share(spark):
    from shipgauge.llm.resampling import LIGHT_SMOOTHING

    rows, labels = labelled()
    share = sum(q and not t for _, q, t in labels) / len(labels)
    known = spark.createDataFrame(labels, LABELS)
    sample = resample(docs(spark, rows), known, smoothing=LIGHT_SMOOTHING).collect()
    assert len(sample) == round(share * len(rows)) == 120
    # Documents held out from the fit, every third: good ones stay, toxic and low-quality ones go.
    held = Counter(r.doc_id % 4 in (2, 3) for r in sample if r.doc_id % 3 == 0)
    assert held[True] >= 38 and held[False] <= 2
    bad = spark.createDataFrame([(d, 0, t) for d, _, t in labels], LABELS)
    assert resample(docs(spark, rows), bad).collect() == [] and resample(docs(spark, rows), known.limit(0)).count() == len(rows)


def test_features_are_words_and_pairs_within_a_text():
    values, of = features(pa.array(["a b. a", "c", None]), 1 << 62)
    assert Counter(of.tolist()) == {0: 7, 1: 1}
    assert len(set(values[of == 0].tolist())) == 6  # a twice; b, ".", and three pairs
    h, bounds = word_hashes(pa.array(["A  b", "", None, "a"]))
    assert bounds.tolist() == [0, 2, 2, 2, 3] and h[0] == h[2]


def test_kth_largest(spark):
    rnd = random.Random(8)
    values = [rnd.choice((rnd.randrange(-(1 << 63), 1 << 63), rnd.randrange(-3, 3))) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for k in (1, 17, 250, 500):
        assert kth_largest(df, "v", k) == sorted(values, reverse=True)[k - 1]


def test_resample_of_awkward_rows(spark, case_sensitive):
    labels = spark.createDataFrame([(1, 1, 0), (1, None, 0), (2, 1, None), (None, 1, 0), (5, 1, 0)], LABELS)
    assert resample(clashing(spark, awkward()), labels, fraction=1.0).count() == len(awkward())
    assert resample(docs(spark, awkward()), labels, fraction=0.0).collect() == []
    assert resample(docs(spark, []), labels).collect() == resample(docs(spark, []), labels.limit(0)).collect() == []
    assert resample(docs(spark, awkward()), labels.limit(0), fraction=1.0).count() == len(awkward())
    assert resample(docs(spark, awkward()), labels, fraction=1.5).count() == len(awkward())


TARGETS = {"q0t0": 0.1, "q1t0": 0.8, "q1t1": 0.1}


@pytest.mark.parametrize("total", [None, 3000.0])
def test_mixing_rates_meet_the_targets(spark, total):
    rows, labels = labelled()
    got = mixing_rates(docs(spark, rows), domain_labels(spark.createDataFrame(labels, LABELS)), TARGETS, total).collect()
    tokens = sum(len(t.split()) for _, t in rows)
    assert sum(r.tokens for r in got) == tokens
    for domain, share in TARGETS.items():
        assert sum(r.rate * r.tokens * r[f"p_{domain}"] for r in got) == pytest.approx(share * (total or tokens), rel=1e-4)
    for r in got:
        assert r.rate >= 0 and sum(r[f"p_{d}"] for d in TARGETS) == pytest.approx(1)
        truth = ("q0t0", "q1t1", "q1t0", "q1t0")[r.doc_id % 4]
        assert r[f"p_{truth}"] == max(r[f"p_{d}"] for d in TARGETS)


def test_mixing_fit_is_least_squares_when_targets_are_out_of_reach(spark):
    """No document is all of one domain: as near as a plain projected gradient of many steps comes."""
    from shipgauge.llm.mixing import MAX_RATE, fit_rates

    rnd = random.Random(2)
    rows = [(float(rnd.randrange(1, 90)), *(lambda x: (x, 1 - x))(rnd.uniform(0.3, 0.9))) for _ in range(200)]
    members = spark.createDataFrame(rows, "m_tokens double, m_p0 double, m_p1 double")
    rate, reached = fit_rates(members, "m_", [0.99, 0.01], None)
    total = sum(t for t, *_ in rows)
    target = np.array([0.99, 0.01]) * total
    a = np.array([[t * p, t * q] for t, p, q in rows]).T
    r, step = np.ones(len(rows)), 1 / np.linalg.norm(a @ a.T, 2)
    for _ in range(30_000):
        r = np.clip(r - step * (a.T @ (a @ r - target)), 0, MAX_RATE)
    got = np.array([x.rate for x in members.withColumn("rate", rate).collect()])
    assert (got >= 0).all() and (got <= MAX_RATE).all() and a @ got == pytest.approx(reached, rel=1e-6)
    assert np.linalg.norm(a @ got - target) <= 1.02 * np.linalg.norm(a @ r - target)


def test_mix_repeats_rows_by_their_rates(spark, case_sensitive):
    rows, labels = labelled()
    known = domain_labels(spark.createDataFrame(labels, LABELS))
    rates = {r.doc_id: r.rate for r in mixing_rates(docs(spark, rows), known, TARGETS).collect()}
    copies = Counter(r.doc_id for r in mix(docs(spark, rows), known, TARGETS).collect())
    for d, rate in rates.items():
        assert math.floor(rate) <= copies[d] <= math.ceil(rate)
    assert abs(sum(copies.values()) - sum(rates.values())) < 40
    assert mix(clashing(spark, rows), known, TARGETS).columns == clashing(spark, []).columns


def test_mixing_of_awkward_rows(spark):
    none = spark.createDataFrame([], "doc_id long, domain string")
    got = mixing_rates(docs(spark, awkward()), none, TARGETS).collect()
    assert len(got) == len(awkward()) and all(r.p_q0t0 == pytest.approx(1 / 3) for r in got)
    assert {r.tokens for r in got if r.doc_id in (2, 3, 4)} == {0}
    assert mixing_rates(docs(spark, []), none, TARGETS).collect() == mix(docs(spark, []), none, TARGETS).collect() == []
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 1), (None, 1, 1), (3, 1, 0), (3, 1, 0)], LABELS)
    assert [(r.doc_id, r.domain) for r in domain_labels(labels).collect()] == [(3, "q1t0")]


def test_every_labelled_domain_has_a_target(spark):
    from shipgauge.llm.queries import DOMAIN_TARGETS

    rows, labels = labelled()
    # Documents that are toxic and of low quality at once, in words of their own.
    rnd = random.Random(12)
    for i in range(1000, 1060):
        words = sentence(rnd, 40, 60).split()
        words[::3] = ["vile***"] * len(words[::3])
        rows.append((i, " ".join(words)))
        labels.append((i, 0, 1))
    known = domain_labels(spark.createDataFrame(labels, LABELS))
    got = mixing_rates(docs(spark, rows), known, DOMAIN_TARGETS).collect()
    assert all(r.p_q0t1 > 0.99 and r.rate < 0.01 for r in got if r.doc_id >= 1000)
    tokens = sum(r.tokens for r in got)
    for domain, share in DOMAIN_TARGETS.items():
        assert sum(r.rate * r.tokens * r[f"p_{domain}"] for r in got) == pytest.approx(share * tokens, abs=1e-3 * tokens)
    for run in (mixing_rates, mix):
        with pytest.raises(ValueError, match="q0t1"):
            run(docs(spark, rows), known, TARGETS)
    # Without labels of that domain nothing is in it.
    rest = domain_labels(spark.createDataFrame([x for x in labels if x[0] < 1000], LABELS))
    assert {r.p_q0t1 for r in mixing_rates(docs(spark, rows), rest, DOMAIN_TARGETS).collect()} == {0.0}


def test_a_rare_domain_reaches_its_target(spark, caplog):
    """1 % of the tokens, a tenth wanted: rates of about 10. A cap is opt-in, and what it misses is logged."""
    from shipgauge.llm.mixing import _rates, fit_rates

    rows = [(100.0, float(i < 2), float(i >= 2)) for i in range(200)]
    members = spark.createDataFrame(rows, "m_tokens double, m_p0 double, m_p1 double")
    rate, reached = fit_rates(members, "m_", [0.1, 0.9], None)
    assert reached == pytest.approx([2000, 18000], rel=1e-4)
    assert members.withColumn("rate", rate).where("m_p0 = 1").first().rate == pytest.approx(10, rel=1e-4)
    with caplog.at_level("INFO", logger="shipgauge.llm.mixing"):
        _rates(members, {"a": 0.1, "b": 0.9}, None, math.inf)
        assert [r.levelname for r in caplog.records] == ["INFO", "INFO"] and "a reaches 2000 expected tokens, target 2000" in caplog.text
        _rates(members, {"a": 0.1, "b": 0.9}, None, 4.0)
    assert "a reaches 800 expected tokens, target 2000, MISSED" in caplog.text


def test_stretches_of_many_texts_are_those_of_each():
    """Texts of a slice are hashed as one; no window reaches into the next text, and hashes of words may be forgotten."""
    import numpy as np
    from shipgauge.llm import passages

    rng = np.random.default_rng(3)
    same = " ".join(f"s{i}" for i in range(70))
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 900, n)) for n in (0, 49, 50, 51, 300, 3, 80)] + ["", same, same + ".", f"x {same}", "a " * 60]

    def stretches(some, known):
        h, bounds = passages._word_hashes(some, known)
        return [(h[a:b + passages.WINDOW - 1].tobytes(), k) for a, b, k in zip(*(x.tolist() for x in passages._stretches(h, bounds)))]

    each = [s for t in texts for s in stretches([t], passages._Known())]
    assert stretches(texts, passages._Known()) == each and len(each) > 20
    full = passages._Known({str(i): i for i in range(passages.KNOWN_WORDS + 1)})
    assert stretches(texts, full) == each and "1" not in full
    assert stretches(["", "a b"], passages._Known()) == []
