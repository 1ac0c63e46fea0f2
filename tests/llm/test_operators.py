"""The training-data operators against brute force, on small tables with nulls, ties, repeats, and clashing columns."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from lexmill.llm import bpe, embedding, fixity, langid, lengths, linededup, mixing, pii, quality, simhash
from lexmill.llm.components import Forest, components

SCHEMA = "doc_id long, text string, lang string, source string, size long, target string, __k1 string, words string"
WORD = r"[^\x20\x09-\x0D]+"


def docs_of(spark, rows):
    """(doc_id, text, lang, source) with columns whose names helpers might use."""
    return spark.createDataFrame([(*r, -1, "t", "k", "w") for r in rows], SCHEMA)


def words(text):
    return re.findall(WORD, text or "")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocab = {"en": "the and of to ing tion".split(), "de": "der und ung keit sch für".split()}
    out = []
    for i in range(120):
        lang = "en" if i % 2 else "de"
        text = "\n".join(" ".join(rng.choice(vocab[lang]) + rng.choice(vocab[lang]) for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 4)))
        out.append((i, text, lang, ["a", "b", "c", None][min(3, i // 35)]))
    out += [(200, None, "en", "a"), (201, "", None, "b"), (202, "1 2 3 !!", "en", None), (None, "the thing of and", None, "a"), (None, None, None, None)]
    out += [out[3], out[3], (204, out[5][1], "en", "c")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return docs_of(spark, rows).cache()


def empty(docs):
    return docs.where("1 = 0")


# --- mixing ---------------------------------------------------------------------------------------------------------
def levels(sizes):
    """Targets by repeated resharing, in plain Python."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    open_, left, out = set(names), float(sum(sizes.values())), {}
    while open_:
        w = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / w > 3 * sizes[s]}
        if not over:
            out |= {s: left * weight[s] / w for s in open_}
            break
        out |= {s: 3.0 * sizes[s] for s in over}
        left -= sum(3.0 * sizes[s] for s in over)
        open_ -= over
    return out


def test_mix_decisions(docs, rows):
    got = mixing.mix_decisions(docs).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    want, taken = levels(sizes), Counter()
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 2 for s in want)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_decisions(docs.repartition(7)).collect()))
    assert mixing.mix_decisions(empty(docs)).count() == 0


def test_mix_shares_what_repeated_rows_get_to_the_last_word(spark):
    """A budget that ends within a document which is there seven times, in rows that differ by another column only."""
    rows = [(1, "w " * 10, "en", "x", k % 3, "t", "k", "w") for k in range(7)] + [(2, "v " * 115, "en", None, 0, "t", "k", "w"), (3, "u " * 13, "en", "z", 0, "t", "k", "w")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix_decisions(docs).collect()
    taken, target = Counter(), {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert taken == {s: int(t + 0.5) for s, t in target.items()} and sum(taken.values()) == 198
    ones = [r.taken for r in got if r.doc_id == 1]
    assert max(ones) - min(ones) <= 1 and sum(ones) % 7
    mixed = mixing.mix_documents(docs).collect()
    assert sum(len(words(r.text)) for r in mixed) == 198
    by = Counter()
    for r in mixed:
        by[r.source] += len(words(r.text))
    assert by == taken


def test_mix_documents_is_the_mix(docs):
    decided = sum(r.taken for r in mixing.mix_decisions(docs).collect())
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    assert sum(len(words(r.text)) for r in mixed.collect()) == decided
    assert mixing.mix_documents(empty(docs)).count() == 0


def test_mix_with_a_capped_source(spark):
    docs = docs_of(spark, [(1, "a b", "en", "x"), (2, "a " * 500, "en", "y"), (3, "b " * 500, "en", "z")])
    by = {r.doc_id: r for r in mixing.mix_decisions(docs).collect()}
    assert by[1].target == 6 and by[1].taken == 6
    assert sum(r.taken for r in by.values()) == 1002


# --- token lengths --------------------------------------------------------------------------------------------------
def test_lengths(docs, rows):
    e = bpe.encoder(*bpe.vocabulary())
    by = defaultdict(list)
    for r in rows:
        by[r[3]].append(len(e.encode(r[1] or "")))
    sums = lengths.suffix_sums(lengths.length_histogram(docs)).cache()
    assert sums.count() == sum(len(set(v)) for v in by.values())
    for r in sums.collect():
        v = by[r.group]
        assert (r.n, r.n_docs, r.n_tokens) == (v.count(r.length), len(v), sum(v))
        assert r.tokens_cut == sum(min(x, r.length) for x in v) and r.docs_over == sum(x > r.length for x in v)
        assert r.tokens_over == sum(x for x in v if x > r.length) and r.share_within == pytest.approx(sum(x <= r.length for x in v) / len(v))
    for r in lengths.at_limits(sums, [0, 1, 17, 10**6]).collect():
        assert r.tokens_cut == sum(min(x, r.limit) for x in by[r.group]) and r.docs_over == sum(x > r.limit for x in by[r.group])
    for r in lengths.quantiles(sums, [0.5, 1.0]).collect():
        assert r.length == sorted(by[r.group])[int(np.ceil(r.share * len(by[r.group]))) - 1]
    assert lengths.suffix_sums(lengths.length_histogram(empty(docs))).count() == 0


# --- language ID ----------------------------------------------------------------------------------------------------
def test_language_id(docs, rows):
    got = langid.identify(docs).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r[2] for r in rows if r[0] is not None and r[0] < 200}
    judged = [(r.lang_pred, truth[r.doc_id]) for r in got if r.doc_id in truth]
    assert sum(a == b for a, b in judged) >= 0.9 * len(judged)
    assert {r.lang_pred for r in got if r.doc_id in (200, 201, 202)} == {"und"}
    assert all(0 <= r.score <= 1 for r in got)


def test_letters_that_nothing_was_learnt_of_take_the_usual_language(spark, docs):
    odd = docs_of(spark, [(1000, "жжж ыыы", None, "a"), (1001, "中", None, "a"), (1002, "12 ?", None, "a")])
    got = {r.doc_id: r for r in langid.identify(docs.unionByName(odd)).collect()}
    assert {got[k].lang_pred for k in (1000, 1001)} <= {"de", "en"} and got[1000].score == got[1001].score == 0
    assert got[1002].lang_pred == "und"
    kept = langid.drop_unidentified(docs.unionByName(odd))
    assert {r.doc_id for r in kept.where("doc_id >= 1000").collect()} == {1000, 1001}


def test_language_filter_against_sets():
    """Predictions from the filter against those from plain sets: false positives are corrected for."""
    rng = random.Random(4)
    own = {"a": [f"{x}{y}" for x in "bcdfg" for y in "aeo"], "b": [f"{x}{y}" for x in "klmnp" for y in "iuo"], "c": [f"{x}{y}" for x in "bcklm" for y in "aiu"]}
    text = lambda k, n: " ".join("".join(rng.choice(own[k]) for _ in range(3)) for _ in range(n))
    grams = lambda t: [h for codes, owner in langid._blocks([t]) for h, _ in langid._grams(codes, owner)]
    terms = [np.unique(np.concatenate(grams(text(k, 300)))) for k in own]
    model = langid.LanguageFilter.of(list(own), terms)
    for _ in range(60):
        k = rng.choice("abc")
        t = text(k, 30)
        h = np.concatenate(grams(t))
        hits = [int(np.isin(h, x).sum()) for x in terms]
        (name,), score = model.predict([t])
        assert name == k == "abc"[int(np.argmax(hits))] and score[0] == pytest.approx(max(hits) / sum(hits), abs=0.03)


def test_language_id_without_labels_and_rows(spark, docs):
    assert {r.lang_pred for r in langid.identify(docs_of(spark, [(1, "the of", None, "a")])).collect()} == {"und"}
    assert langid.identify(empty(docs)).count() == 0
    kept = langid.drop_unidentified(docs)
    assert kept.columns == docs.columns and kept.where("doc_id in (200, 201, 202)").count() == 0


def test_language_blocks_count_each_gram_once(monkeypatch):
    texts = ["Hello wörld foo bar " * 9, None, "", "a", "1234 !!", "x\0y zz"]

    def totals():
        n = [0] * len(texts)
        for codes, owner in langid._blocks(texts):
            for _, at in langid._grams(codes, owner):
                for o in owner[at]:
                    n[o] += 1
        return n

    whole = totals()
    monkeypatch.setattr(langid, "BLOCK", 50)
    assert totals() == whole


# --- fixity ---------------------------------------------------------------------------------------------------------
def test_fixity_finds_what_differs(spark, monkeypatch):
    monkeypatch.setattr(fixity, "SPAN", 512)
    monkeypatch.setattr(fixity, "FANOUT", 3)
    pages = spark.createDataFrame([(i, f"u{i}", f"<p>{i}</p>" * (i % 9)) for i in range(60)] + [(None, None, None), (7, "u7", "<p>7</p>" * 7)], "page_id long, url string, html string")
    ours, same = fixity.page_archive(pages)
    assert ours.count() == 62 and fixity.audit(ours, same).count() == 0
    rows = [tuple(r) for r in ours.collect()]
    assert all(b[1] == a[1] + a[2] for a, b in zip(sorted(rows), sorted(rows)[1:], strict=False) if a[0] == b[0])
    broken = [(f, o, n, "0" * 64) if k in (5, 40) else (f, o, n, d) for k, (f, o, n, d) in enumerate(rows) if k != 11] + [(0, 10**6, 5, "1" * 64)]
    found = fixity.audit(ours, spark.createDataFrame(broken, ours.schema)).collect()
    assert sorted((r.offset, r.status) for r in found) == sorted([(rows[5][1], "corrupt"), (rows[40][1], "corrupt"), (rows[11][1], "missing"), (10**6, "extra")])
    root = lambda t: fixity.archive_root(fixity.tree(t, fixity.depth(t))).first().root
    assert root(ours) == root(same) != root(spark.createDataFrame(broken, ours.schema))
    nothing = fixity.page_archive(pages.where("1 = 0"))
    assert fixity.audit(*nothing).count() == 0


# --- surrogates -----------------------------------------------------------------------------------------------------
KEY = b"tests"


def test_surrogates_keep_type_format_and_identity(spark):
    text = "Write to Jo.Doe@mail.example.com or jo.doe@mail.example.com, +1 (743) 555-3824, card 4111 1111 1111 1111, 152.143.123.131, Mrs. Maria Schmidt; later Maria, MARIA and Schmidt. No card: 4111 1111 1111 1112."
    docs = docs_of(spark, [(1, text, "en", "a"), (2, "again jo.doe@mail.example.com", "en", "a"), (3, None, "en", "a"), (4, "", "en", "a"), (2, "again jo.doe@mail.example.com", "en", "a")])
    got = {r.doc_id: r for r in pii.replace_documents(docs, KEY).collect()}
    new = got[1].text
    assert got[1].entity_types == "card:1,email:2,ip:1,name:5,phone:1" and not any(x in new for x in ("Doe", "743", "4111 1111 1111 1111", "152.143", "Schmidt", "Maria", "MARIA"))
    assert "4111 1111 1111 1112" in new
    mails = re.findall(r"\S+@\S+\.com", new)
    assert mails[0].lower() == mails[1].rstrip(",") and mails[1].rstrip(",") in got[2].text
    assert pii.luhn(re.sub(r"\D", "", re.search(r"\d{4} \d{4} \d{4} \d{4}", new)[0])) and re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", new)
    given, family = re.search(r"Mrs\. (\w+) (\w+);", new).groups()
    assert given.endswith("a") and f"later {given}, {given.upper()} and {family}." in new
    assert got[3].text is None and got[4].text == "" and got[4].n_entities == 0
    assert pii.replace_documents(empty(docs), KEY).count() == 0
    other = {r.doc_id: r.text for r in pii.replace_documents(docs, b"another").collect()}
    assert other[1] != new and other[3] is None


def test_surrogates_are_permutations():
    assert sorted(pii._permuted(KEY, x, 777, b"t") for x in range(777)) == list(range(777))
    seen = {pii.surrogate(KEY, "ssn", f"{a:03d}-{b:02d}-0001") for a in range(30) for b in range(30)}
    assert len(seen) == 900


def test_numbers_keep_country_and_check_digits():
    a, b, c = (pii.surrogate(KEY, "phone", x) for x in ("+1 415 555 1234", "+14155551234", "(415) 555-1234"))
    assert a.startswith("+1 ") and b.startswith("+1") and re.sub(r"\D", "", a) == b[1:] == "1" + re.sub(r"\D", "", c)
    assert pii.surrogate(KEY, "phone", "+49 30 123456").startswith("+49 ") and pii.surrogate(KEY, "phone", "+35930123456").startswith("+359")
    iban = "DE89 3704 0044 0532 0130 00"
    assert [x[2] for x in pii.entities(f"pay {iban} now")] == ["iban"] and pii.entities("pay DE88 3704 0044 0532 0130 00 now") == []
    new = pii.surrogate(KEY, "iban", iban)
    assert new != iban and re.fullmatch(r"DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d", new) and [x[2] for x in pii.entities(f"pay {new} now")] == ["iban"]


def test_genders_come_from_titles_names_and_endings(spark):
    rows = [(1, "Mrs Ingrid Moss and Mr Joshua Moss met Alice Grey.", "en", "s"), (2, "Ms Ingrid Hill. Frau Moss", "en", "s"), (3, "Господин Мичил Петров, Госпожа Дайаана Петрова", "en", "s")]
    got = {r.doc_id: r.text for r in pii.replace_documents(docs_of(spark, rows), KEY).collect()}
    f1, s1, m1, s2, f2, _ = re.fullmatch(r"Mrs (\w+) (\w+) and Mr (\w+) (\w+) met (\w+) (\w+)\.", got[1]).groups()
    assert s1 == s2 and f1.endswith("a") and f2.endswith("a") and not m1.endswith("a")
    assert re.fullmatch(rf"Ms {f1} \w+\. Frau {s1}", got[2])
    m, _, f, _ = re.fullmatch(r"Господин (\w+) (\w+), Госпожа (\w+) (\w+)", got[3]).groups()
    assert f.endswith("а") and not m.endswith("а") and all("а" <= c.lower() <= "я" for c in m + f)


def test_surrogates_against_brute_force(spark):
    """Every entity by hand: surrogates that are taken drawn again one round after the other, over plain dictionaries."""
    rng = random.Random(6)
    a = "123-45-6789"
    pool = [f"{rng.choice(['Mr', 'Mrs', 'Dr'])} {g} {s}" for g in ("Anna", "Kim", "Paul", "Lo") for s in ("Dodolo", "Bakira", "Oz", "Stone", "Kikira", "Bododo")]
    # originals that are surrogates of others, and so of others again
    chain = ["Stone"]
    for _ in range(4):
        chain.append(pii.surrogate(KEY, "name", chain[-1], 0, "m"))
    pool += [f"Mr {x} Oz" for x in chain] + [f"Mr {pii.surrogate(KEY, 'name', 'Oz')}", a, pii.surrogate(KEY, "ssn", a)] + [f"+1 {rng.randrange(10**3, 10**4)} {rng.randrange(100, 1000)}" for _ in range(30)] + ["a@b.co", "e@c.co", "i@d.co"]
    rows = [(k, " und ".join(rng.choice(pool) for _ in range(rng.randint(0, 6))), "en", "s") for k in range(150)] + [(900, None, "en", "s"), (3, "x", "en", "s")]
    told, seen = defaultdict(Counter), {}
    for _, t, *_ in rows:
        for s, e, kind, name, g in pii.entities(t):
            told[kind, name][g] += 1
            seen[kind, name] = min(seen.get((kind, name), t[s:e]), t[s:e])
    gender = {k: "f" if c["f"] > c["m"] else "m" if c["m"] > c["f"] else None for k, c in told.items()}
    draw = dict.fromkeys(seen, 0)
    while True:
        made = {k: pii.canonical(k[0], pii.surrogate(KEY, k[0], seen[k], draw[k], gender[k])) for k in seen}
        taken = [k for k in seen if (k[0], made[k]) in seen or any(o[0] == k[0] and o[1] < k[1] and made[o] == made[k] for o in seen)]
        if not taken:
            break
        for k in taken:
            draw[k] += 1
    assert sum(draw.values()) >= 6 and len({(k[0], v) for k, v in made.items()}) == len(seen)
    docs = docs_of(spark, rows)
    want = Counter((i, *pii.replace(KEY, t, {k: (draw[k], gender[k]) for k in seen})) for i, t, *_ in rows)
    assert Counter((r.doc_id, r.text, r.n_entities, r.entity_types) for r in pii.replace_documents(docs, KEY).collect()) == want


def test_taken_surrogates_are_drawn_again(spark):
    a = "123-45-6789"
    b = pii.surrogate(KEY, "ssn", a)
    docs = docs_of(spark, [(1, f"x {a} y", "en", "s"), (2, f"x {b} y", "en", "s")])
    got = {r.doc_id: r.text for r in pii.replace_documents(docs, KEY).collect()}
    assert got[1] != got[2] and b not in got[1] and a not in got[2]


# --- line dedup -----------------------------------------------------------------------------------------------------
def gone_by_hand(rows):
    found = []
    for i, text in rows:
        for k, line in enumerate((text or "").split("\n")):
            w = words(line)
            if w:
                found.append((i, k, w))
    found.sort(key=lambda x: x[:2])

    def near(a, b):
        if a == b:
            return True
        if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < linededup.NEAR_WORDS:
            return False
        p = q = 0
        while p < min(len(a), len(b)) and a[p] == b[p]:
            p += 1
        while q < min(len(a), len(b)) - p and a[-1 - q] == b[-1 - q]:
            q += 1
        return p + q >= max(len(a), len(b)) - 1

    return {y[:2] for n, y in enumerate(found) if any(near(x[2], y[2]) for x in found[:n])}


@pytest.mark.parametrize("piece", [256, 4])
def test_line_dedup_against_all_pairs(spark, monkeypatch, piece):
    monkeypatch.setattr(linededup, "PIECE", piece)
    rng = random.Random(3)
    base = [[rng.choice("a bb c dé e".split()) for _ in range(rng.randint(9, 14))] for _ in range(25)] + [["Home"], ["home"], ["a", "b"], ["a", "c"], ["x"] * 9]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randint(0, 6)):
            w = list(rng.choice(base))
            for _ in range(rng.randint(0, 2)):
                k = rng.randrange(len(w) + 1)
                w[k : k + rng.randint(0, 1)] = rng.choice([[], ["zz"], ["y"]])
            lines.append(rng.choice([" ", "  ", "\t"]).join(w))
        rows.append((i, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "x " * 5), (103, " \t\nHome\n\n\r Home\x0b"), (104, "p\rq"), (105, "p q")]
    docs = docs_of(spark, [(i, t, "en", "a") for i, t in rows])
    got = linededup.line_report(docs).collect()
    assert len(got) == len(rows)
    want = gone_by_hand(rows)
    assert {(r.doc_id, int(k)) for r in got for k in r.dropped.split(",") if k} == want
    kept = {r.doc_id: r.text for r in linededup.dedup_lines(docs).collect()}
    for i, text in rows:
        left = None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if (i, k) not in want)
        if i in kept:
            assert kept[i] == left
        else:
            assert not words(left) and words(text)
    assert linededup.dedup_lines(docs).columns == docs.columns
    assert linededup.dedup_lines(empty(docs)).count() == 0 and linededup.line_report(empty(docs)).count() == 0


def test_line_dedup_of_repeated_rows_and_many_near_lines(spark):
    line = "one two three four five six seven eight nine ten"
    docs = docs_of(spark, [(1, line, "en", "a"), (1, line, "en", "a"), (None, line, "en", "a")] + [(10 + i, f"{line} {i}", "en", "a") for i in range(200)])
    kept = linededup.dedup_lines(docs).collect()
    assert [r.doc_id for r in kept] == [1, 1]


# --- SimHash --------------------------------------------------------------------------------------------------------
def by_hand(text):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(text)]
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def test_simhash_against_all_pairs(docs, rows):
    got = simhash.simhash(docs).collect()
    assert len(got) == len(rows)
    fps = [by_hand(r[1]) for r in rows]
    x = np.array(fps, np.uint64)
    forest = Forest(len(x))
    forest.link(*np.nonzero(np.bitwise_count(x[:, None] ^ x[None, :]) <= 2))
    least = defaultdict(list)
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[forest.label[k]].append(r[0])
    want = Counter((r[0], fps[k], min(least[forest.label[k]], default=None)) for k, r in enumerate(rows))
    assert Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in got) == want
    assert simhash.simhash(empty(docs)).count() == 0


def test_simhash_keeps_one_of_each_group(docs):
    kept = simhash.dedup_documents(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.where("doc_id is not null").collect()]
    assert len(ids) == len(set(ids)) == simhash.simhash(docs).where("doc_id = component_id").select("doc_id").distinct().count()


@pytest.mark.parametrize("node_rows", [8192, 20])
def test_index_links_what_all_pairs_link(spark, monkeypatch, node_rows):
    monkeypatch.setattr(simhash, "NODE_ROWS", node_rows)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**64, size=30, dtype=np.uint64)
    x = base[rng.integers(0, 30, 1500)]
    for _ in range(5):
        x = x ^ (np.uint64(1) << rng.integers(0, 64, 1500, dtype=np.uint64)) * (rng.random(1500) < 0.6).astype(np.uint64)
    x = np.unique(x).view(np.int64)
    x.sort()
    links = simhash.link_fingerprints(spark.createDataFrame([(int(v),) for v in x], "fp long"))
    root = {r.node: r.root for r in components(links).collect()}
    forest = Forest(len(x))
    forest.link(*np.nonzero(np.bitwise_count((x[:, None] ^ x[None, :]).view(np.uint64)) <= 2))
    assert all(root.get(int(v), int(v)) == int(x[forest.label[k]]) for k, v in enumerate(x))


def test_components_of_a_chain_a_star_and_nulls(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3), (200, None)]
    root = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert root == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- embeddings -----------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("tile", [1024, 16])
def test_embedding_links_against_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(embedding, "TILE", tile)
    rng = np.random.default_rng(2)
    centre = rng.standard_normal((12, 24))
    rows = [(i, (centre[i % 12] + rng.standard_normal(24) * (0.12 if i % 3 else 0.9)).astype(np.float32).tolist(), i % 2) for i in range(240)]
    rows += [(900, None, 1), (901, [1.0] * 24, None), (902, [0.0] * 24, 0), (903, [float("nan")] * 24, 0), (904, [None] + [1.0] * 23, 0), (905, [], 0), (906, [1.0, 2.0], 0), (907, rows[0][1], 0), (908, [2 * x for x in rows[0][1]], 0)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<float>, label int, rid int")
    got = {r.vec_id: r for r in embedding.embedding_links(df).collect()}
    assert len(got) == len(rows)
    fine = [r for r in rows if r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    groups = defaultdict(list)
    for r in fine:
        groups[r[2], len(r[1])].append(r)
    want = {r[0]: (0, r[0]) for r in rows}
    for g in groups.values():
        x = np.array([r[1] for r in g], np.float32).astype(np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        near = x @ x.T >= 0.93
        forest = Forest(len(g))
        forest.link(*np.nonzero(near))
        want |= {r[0]: (int(near[k].sum()) - 1, g[forest.label[k]][0]) for k, r in enumerate(g)}
    assert {k: (r.n_links, r.component_id) for k, r in got.items()} == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert embedding.embedding_links(df.where("1 = 0")).count() == 0


# --- quality --------------------------------------------------------------------------------------------------------
def test_rule_statistics():
    rng = random.Random(1)
    for _ in range(500):
        t = "".join(rng.choice("ab \n\t\x0b\x1c\x85 #é") for _ in range(rng.randint(0, 60)))
        w, seen, dup = words(t), set(), 0
        for line in t.split("\n"):
            if words(line):
                dup += line in seen
                seen.add(line)
        c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        often = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        assert quality.statistics(t) == (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), dup, len(often))
    assert quality.statistics(None) == (0,) * 5


def test_quality_verdicts(spark):
    rng = random.Random(4)
    good = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(60, 120)))
    # few anomalies, as isolation by random splits assumes
    rows = [(i, good() if i % 20 else good().replace(" ", "### ", 60), "en", "a") for i in range(200)] + [(500, None, "en", "a"), (501, "a b " * 60, "en", "a"), (502, "short", "en", "a")]
    labels = spark.createDataFrame([(i, int(i % 20 > 0), 9) for i in range(200)] + [(None, 1, 9), (3, None, 9)], "doc_id long, quality int, anomaly int")
    got = {r.doc_id: r for r in quality.judge(docs_of(spark, rows), labels).collect()}
    assert len(got) == len(rows) and all(got[i].base_failed and not got[i].kept for i in (500, 501, 502))
    assert sum(got[i].kept for i in range(200) if i % 20) >= 0.95 * 190 and sum(got[i].kept for i in range(0, 200, 20)) <= 1
    none = quality.judge(docs_of(spark, rows), labels.where("1 = 0")).collect()
    assert len(none) == len(rows)
    assert quality.judge(docs_of(spark, rows).where("1 = 0"), labels).count() == 0


def test_quality_verdicts_against_brute_force(spark):
    """Each document down each tree by hand, and the threshold by trying every bin."""
    rng = random.Random(9)
    rows = []
    for i in range(300):
        w = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(30, 400))]
        w = [x + "#" * (rng.random() < 0.02 * (i % 7)) for x in w]
        rows.append((i, "".join(x + (" " if rng.random() < 0.8 else "\n") for x in w + w[: rng.randint(0, 20) * (i % 2)]), "en", "a"))
    rows += [rows[5], (1000, None, "en", "a")]
    marks = [(i, rng.randint(0, 1), 0) for i in range(0, 300, 2)]
    marks += [marks[0], (marks[1][0], 1 - marks[1][1], 0), (5000, 1, 0), (None, 1, 0), (7, None, 0)]
    got = quality.judge(docs_of(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, anomaly int")).collect()
    stats = [(r[0], quality.statistics(r[1])) for r in rows]
    failed = lambda s: s[0] < 50 or 100 * s[4] > 50 * s[0]
    sample = np.array([s for _, s in stats if not failed(s)], float)
    forest = quality.IsolationForest.fit(quality.features(sample[np.lexsort(sample.T)]))
    assert {f for f in forest.feature.ravel().tolist() if f >= 0} == {0, 1, 2, 3, 4}

    def score(s):
        x, total = quality.features(np.array([s], float))[0], 0.0
        for t in range(quality.TREES):
            at = 0
            while (f := forest.feature[t, at]) >= 0:
                at = forest.child[t, at] + (1 if x[f] > forest.value[t, at] else 0)
            total += forest.path[t, at]
        return 2 ** (-total / quality.TREES / forest.norm)

    graded = [(score(s), q) for i, s in stats if not failed(s) for q in {q for j, q, _ in marks if j == i and q is not None}]
    good, bad = [b for b, q in graded if q == 1], [b for b, q in graded if q == 0]
    best = (-1.0, 0.0)
    for k in range(1, quality.BINS + 2):
        kept, out = sum(int(b * quality.BINS) < k for b in good) / len(good), sum(int(b * quality.BINS) >= k for b in bad) / len(bad)
        if kept >= quality.KEEP_GOOD and kept + out > best[0] + 1e-12:
            best = (kept + out, k / quality.BINS)
    want = Counter((i, *s, failed(s), not failed(s) and score(s) <= best[1]) for i, s in stats)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in got) == want
    assert len({w[-1] for w in want}) == 2


# --- BPE ------------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def reference():
    import base64

    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_against_the_library(spark, docs, rows, reference):
    got = bpe.encode_documents(docs, with_ids=True).collect()
    want = Counter()
    for r in rows:
        ids = reference.encode_ordinary(r[1] or "")
        want[r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest(), tuple(ids)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.token_ids)) for r in got) == want
    back = bpe.decode_ids(bpe.encode_documents(docs, with_ids=True)).collect()
    assert Counter(bytes(r.decoded).decode() for r in back) == Counter(r[1] or "" for r in rows)
    assert bpe.encode_documents(empty(docs)).count() == 0


def test_bpe_on_odd_texts(reference):
    e, rng = bpe.encoder(*bpe.vocabulary()), random.Random(2)
    pool = [chr(c) for c in [*range(0x500), *range(0x2000, 0x2070), 0x3000, 0x1F600, 0x4E2D, 0x180E, 0xFEFF, 0x661, 0x2155]]
    for _ in range(1500):
        t = "".join(rng.choice(pool) if rng.random() < 0.5 else rng.choice("aeth in 's'll12 \n\t") for _ in range(rng.randint(0, 60)))
        ids = e.encode(t)
        assert ids == reference.encode_ordinary(t) and e.decode(ids) == t.encode()
    long = "ab" * 20_000
    assert e.encode(long) == reference.encode_ordinary(long)


@pytest.mark.parametrize("long", [64, 1024])
def test_bpe_forgets_within_bounds(monkeypatch, reference, long):
    monkeypatch.setattr(bpe, "LONG", long)
    monkeypatch.setattr(bpe, "KEPT_BYTES", 20_000)
    monkeypatch.setattr(bpe, "PART", 50)
    e, rng = bpe.Encoder(*bpe.vocabulary()), random.Random(7)
    for _ in range(40):
        t = " ".join("".join(rng.choice("abcdé中") for _ in range(rng.choice([3, 5, 9, 200]))) for _ in range(120))
        ids = reference.encode_ordinary(t)
        want = len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()
        assert e.digest(t) == want and e.count(t) == len(ids)
        assert sum(map(len, e.texts)) <= 40_000 and e.texts.keys() == e.raws.keys() == e.sizes.keys()


def test_perfect_hash_is_minimal():
    keys = [f"k{i}".encode() for i in range(3000)]
    h = bpe.PerfectHash(keys)
    assert [h.find(k) for k in keys] == list(range(3000)) and h.find(b"other") == -1 and len(h.keys) == 3000
