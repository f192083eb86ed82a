"""Quality rules, language identification, decontamination and chat formatting on small tables."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cuesheet.llm import chat, language, latent, quality
from tests.llm.helpers import clashing, frame, odd_documents, words


def in_runs(w, n):
    seen = Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
    return {k + d for k in range(len(w) - n + 1) if seen[tuple(w[k : k + n])] > 1 for d in range(n)}


def in_later_runs(w, n):
    grams = [tuple(w[k : k + n]) for k in range(len(w) - n + 1)]
    return {k + d for k, g in enumerate(grams) if g in set(grams[:k]) for d in range(n)}


def plain_rules(text):
    text = text or ""
    w, seen, dup, dup_chars = words(text), set(), 0, 0
    for line in text.split("\n"):
        if words(line):
            if line in seen:
                dup, dup_chars = dup + 1, dup_chars + len(line)
            seen.add(line)
    runs = [sum(len(w[k]) for k in in_later_runs(w, n)) for n in quality.MAX_RUN_SHARE]
    chars, repeat = sum(map(len, w)), len(in_runs(w, 3))
    failed = len(w) < 50 or 100 * repeat > 50 * len(w)
    fine = dup_chars <= quality.MAX_LINE_SHARE * chars and all(r < quality.LEAST_CHARS or r <= s * chars for r, s in zip(runs, quality.MAX_RUN_SHARE.values()))
    return (len(w), chars, sum(text.count(c) for c in "#*$%&|<>"), dup, repeat, dup_chars, *runs, failed, not failed and fine)


def test_quality_rules(spark):
    rng = random.Random(8)
    make = lambda n, k: " ".join(f"w{rng.randrange(k)}" for _ in range(n))
    half = make(40, 10**6)
    more = [(30, make(300, 6)), (31, half + " " + make(60, 10**6) + " " + half), (32, "\n".join(["a line of é words #1"] * 20)), (33, "\n\n|x|\n\n|x|\n" * 30), (34, make(50, 10**6)), (35, make(49, 10**6))]
    rows = odd_documents() + more
    out = quality.repetition_rules(clashing(frame(spark, rows)))
    got = Counter((r.doc_id, tuple(r[c] for c in quality.COUNTS) + (r.base_failed, r.kept)) for r in out.collect())
    assert got == Counter((i, plain_rules(t)) for i, t in rows)
    assert quality.repetition_rules(frame(spark, rows).filter("false")).count() == 0


def test_short_texts_fail_by_run_shares_alone(spark):
    """A run of twelve words that comes twice in 62 words fails, one of five words in 400 doesn't; both pass the base rules."""
    plain = [f"w{k}" for k in range(400)]
    rows = [(1, " ".join(plain[:50] + plain[:12])), (2, " ".join(plain + plain[:5])), (3, " ".join(plain[:60]))]
    got = {r.doc_id: r for r in quality.repetition_rules(frame(spark, rows)).collect()}
    assert got[1].dup_chars_5 < 100 and got[1].dup_chars_5 > 0.15 * got[1].word_chars and got[1].n_dup_lines == 0
    assert not any(r.base_failed for r in got.values())
    assert {i: r.kept for i, r in got.items()} == {1: False, 2: True, 3: True}


SYLLABLES = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "er", "ung", "zw"], "cc": ["ção", "que", "os", "é"]}


def spoken(lang, n, rng):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(n))


def labelled(spark, n=60):
    rng = random.Random(2)
    rows = [(i, spoken(lang := rng.choice(list(SYLLABLES)), rng.randint(4, 60), rng), lang, f"https://{lang}.example.{rng.choice(['org', lang])}/x") for i in range(n * 3)]
    return rows, spark.createDataFrame(rows, "doc_id bigint, text string, lang string, url string")


def test_held_out_accuracy(spark):
    rows, df = labelled(spark)
    model = language.fit(df.filter("doc_id % 3 > 0"))
    held = language.identify(df.filter("doc_id % 3 = 0"), model, F.col("text")).collect()
    assert sum(r.language == r.lang for r in held) >= 0.9 * len(held) and all(r.language_known for r in held)


def test_every_label_with_enough_rows_is_learnt(spark):
    """70 languages, the last six with the fewest rows: their documents keep their own language."""
    rng = random.Random(5)
    own = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(70)]
    spell = lambda k: " ".join("".join(rng.choices(own[k], k=rng.randint(2, 7))) for _ in range(60))
    rows = [(spell(k), f"l{k:02}", f"https://h.l{k:02}/") for k in range(70) for _ in range(8 if k < 64 else 6)] + [(spell(0), "rare", None)] * 4
    df = spark.createDataFrame(rows, "text string, lang string, url string")
    model = language.fit(df)
    assert model["names"] == [f"l{k:02}" for k in range(70)]
    for out in (language.identify(df, model, F.col("text"), F.col("lang"), F.col("url")), language.identify(df, model, F.col("text"))):
        got = out.filter("lang >= 'l64' AND lang < 'm'").collect()
        assert len(got) == 36 and all(r.language_known and r.language == r.lang for r in got)


def test_evidence_decides_where_text_does_not(spark):
    rows, df = labelled(spark)
    model = language.fit(df)
    odd = [
        (900, "x", "bb", "https://bb.example.bb/"), (901, None, "aa", "https://aa.example.aa/"), (902, "", None, None), (903, "12 %% 34", "aa", None),
        (904, "x", None, "https://cc.example.cc/y"), (905, "x", None, None), (906, "一" * 3000, "aa", None), (None, "ka lo mi", "zz", "no url"),
    ]
    every = df.union(spark.createDataFrame(odd, df.schema))
    out = language.identify(clashing(every), model, F.col("text"), F.col("lang"), F.col("url"))
    assert out.columns == [c for c in clashing(every).columns if c != "language"] + ["language", "language_p", "language_known"]
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == every.count()
    assert got[900].language == "bb" and got[904].language == "cc" and got[None].language == "aa" and got[905].language_known
    assert [got[i].language for i in (901, 902, 903)] == ["und"] * 3
    assert not got[906].language_known or got[906].language == "aa"
    assert language.identify(df.filter("false"), model, F.col("text"), F.col("lang"), F.col("url")).count() == 0
    assert {r.language for r in language.identify(df, language.fit(df.filter("false")), F.col("text")).collect()} == {"und"}


def test_address_and_markup(spark):
    row = spark.createDataFrame([("https://www.a.example.fr:80/de/x?y", "<!doctype html><HTML class=x lang='fr-CA'>")], "u string, h string")
    got = row.select(language.host_of(F.col("u")), language.domain_of(language.host_of(F.col("u"))), language.suffix_of(F.col("u")), language.declared_in(F.col("h"))).first()
    assert tuple(got) == ("www.a.example.fr", "example.fr", "fr/de", "fr")


def leaks(spark):
    rng = random.Random(6)
    vocab = ["".join(rng.choices("abcdefgilmnorstu", k=rng.randint(3, 8))) for _ in range(3000)]
    make = lambda n: [rng.choice(vocab) if rng.random() < 0.6 else rng.choice(["the", "of", "and", "in"]) for _ in range(n)]
    items = {i: make(n) for i, n in enumerate((40, 25, 55, 15, 150, 30, 6, 33))}
    swapped = list(items[5])
    for k in (3, 9, 14, 20):
        swapped[k] = "other"
    answer_only = [w if k >= 25 or k % 2 else "new" for k, w in enumerate(items[5])]
    bits = items[0][:10]
    docs = {
        1: make(200) + items[0] + make(90), 2: [w.upper() + "," for w in items[1]], 3: make(33) + items[2], 4: items[3] + make(500), 5: make(75) + items[4] + make(10),
        6: make(100) + swapped + make(40), 7: make(20) + answer_only + make(20), 8: make(50) + items[6] + make(50), 9: make(400), 10: make(60) + bits + make(60), 11: make(40) + items[6][:3] + ["x"] + items[6][3:],
    }
    want = {(1, 0), (2, 1), (3, 2), (4, 3), (5, 4), (6, 5), (7, 5), (8, 6)}
    rows = [(d, " ".join(w), "en", "s", 0) for d, w in docs.items()] + [(12, None, "en", "s", 0), (13, "", "en", "s", 0), (1, " ".join(docs[1]), "en", "s", 0), (None, " ".join(docs[1]), "en", "s", 0)]
    from tests.llm.helpers import SCHEMA

    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(90, None), (91, ""), (92, "..."), (None, "the")], "item_id bigint, text string")
    return spark.createDataFrame(rows, SCHEMA), bench, want | {(None, 0)}


@pytest.mark.parametrize("block", [240, 3])
def test_leaks_are_found_and_clean_documents_left(spark, monkeypatch, block):
    """Verbatim, shouted, cut in two passages, with words changed, with the answer kept; also over several blocks."""
    monkeypatch.setattr(latent, "BLOCK", block)
    docs, bench, want = leaks(spark)
    got = latent.benchmark_matches(clashing(docs), bench)
    rows = got.collect()
    assert {(r.doc, r.item) for r in rows} == want and len(rows) == len(want)
    assert latent.benchmark_matches(docs.filter("false"), bench).count() == 0
    assert latent.benchmark_matches(docs, bench.filter("false")).count() == 0


def test_common_subsequences_are_exact(spark):
    docs, bench, want = leaks(spark)
    texts = {r.doc_id: r.text.lower().replace(",", "").split() for r in docs.filter("text IS NOT NULL AND doc_id IS NOT NULL").collect()}
    items = {r.item_id: r.text.split() for r in bench.filter("item_id < 90").collect()}

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for k, y in enumerate(b):
                new.append(row[k] + 1 if x == y else max(row[k + 1], new[k]))
            row = new
        return row[-1]

    for r in latent.benchmark_matches(docs, bench).collect():
        if r.doc is not None and len(items[r.item]) <= latent.ITEM_WORDS:
            w = texts[r.doc][max(0, r.place - latent.STRIDE) : r.place + 3 * latent.STRIDE]
            assert r.common == lcs(w, items[r.item])


def plain_leaks(docs, items):
    """(doc, item) by every passage against every item: no candidate search."""
    found = set()
    for d, text in docs.items():
        w = text.split()
        for start in range(0, max(1, -(-len(w) // latent.STRIDE) - 1) * latent.STRIDE, latent.STRIDE):
            near = w[max(0, start - latent.STRIDE) : start + 3 * latent.STRIDE]
            for i, item in items.items():
                x, row = item.split(), [0] * (len(near) + 1)
                for a in x:
                    new = [0]
                    for k, b in enumerate(near):
                        new.append(row[k] + 1 if a == b else max(row[k + 1], new[k]))
                    row = new
                own = x[-latent.ANSWER_WORDS :]
                answered = any(near[k : k + len(own)] == own for k in range(len(near)))
                share = row[-1] / len(x)
                if answered and share == 1 if len(x) < latent.SHORT_ITEM else share >= latent.SURE or answered and share >= latent.LIKELY:
                    found.add((d, i))
    return found


def found_leaks(spark, docs, items):
    docs = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    items = spark.createDataFrame(list(items.items()), "item_id bigint, text string")
    return {(r.doc, r.item) for r in latent.benchmark_matches(docs, items).collect()}


@pytest.mark.parametrize("length", [6, 8, 12])
def test_short_items_side_by_side(spark, length):
    """Questions listed one after another: copies, copies with a word changed, and the answer with half of the rest."""
    rng = random.Random(length)
    vocab = ["".join(rng.choices("abcdefgilmnorstu", k=rng.randint(3, 8))) for _ in range(900)]
    item = lambda: " ".join(rng.choice(vocab) if rng.random() < 0.6 else rng.choice(["the", "of", "and", "in"]) for _ in range(length))
    items = {i: item() for i in range(60)}
    changed = [" ".join("new" if k == length // 3 else x for k, x in enumerate(t.split())) for t in items.values()]
    halved = [" ".join("new" if k < length - latent.ANSWER_WORDS and k % 2 else x for k, x in enumerate(t.split())) for t in items.values()]
    docs = {1: " ".join(items.values()), 2: " ".join(changed), 3: " ".join(halved), 4: " ".join(item() for _ in range(60))}
    want = plain_leaks(docs, items)
    assert {(1, i) for i in items} <= want
    assert found_leaks(spark, docs, items) == want


def test_copies_without_the_rare_terms(spark):
    """An item's few rare words are changed; the common ones, 83 % in order, stand in most other documents too."""
    rng = random.Random(3)
    common = [f"c{k}" for k in range(40)]
    items = {i: " ".join(f"r{i}x{k}" if k % 6 == 2 else rng.choice(common) for k in range(42)) for i in range(3)}
    fill = lambda n: " ".join(rng.choice(common) if rng.random() < 0.3 else f"f{rng.randrange(5000)}" for _ in range(n))
    docs = {i: f"{fill(70)} {' '.join('new' if x[0] == 'r' else x for x in items[i].split())} {fill(70)}" for i in items} | {10 + k: fill(200) for k in range(60)}
    want = plain_leaks(docs, items)
    assert {(i, i) for i in items} <= want
    assert found_leaks(spark, docs, items) == want


def test_blocks_hold_no_more_passages_than_the_latent_space(spark):
    """A long item of prose and items like code, whose words are parted by punctuation, beside short ones."""
    rng = random.Random(12)
    prose = " ".join(f"w{rng.randrange(9000)}" for _ in range((latent.RANK + 40) * latent.ITEM_STRIDE))
    code = "\n".join(f"f{k}.bar(baz{k},qux);x[i{k}]=y[j{k}]+z(a,b,c)" for k in range(60))
    rows = [(1, prose, None), *((k, code, None) for k in range(2, 40)), (90, "four words are enough", None), (91, "not these", None)]
    blocks = list(latent._blocks(spark.createDataFrame(rows, "item bigint, text string, answer string")))
    assert latent.BLOCK <= latent.RANK and all(0 < len(b.ids) <= latent.BLOCK for b in blocks) and len(blocks) > 2
    passages = lambda n: 1 + max(0, -(-(n - latent.ITEM_WORDS) // latent.ITEM_STRIDE))
    want = Counter({i: passages(len(re.findall(r"[a-z0-9]+", t))) for i, t, _ in rows if i != 91})
    assert Counter(i for b in blocks for i in b.ids) == want


def plain_best(messages):
    """Every root-to-leaf path by walking up from each leaf."""
    by = {}
    for c, m, p, role, text, score in messages:
        if m is not None:
            by.setdefault(c, {})
            by[c][m] = min(by[c].get(m, (p, role, text, score)), (p, role, text, score), key=lambda r: tuple((x is not None, x or 0 if not isinstance(x, str) else x) for x in r))
    out = {}
    for c, nodes in by.items():
        parents, best = {r[0] for r in nodes.values()}, []
        for leaf in nodes:
            if leaf in parents:
                continue
            path, at = [], leaf
            while at in nodes and at not in path:
                path.append(at)
                at = nodes[at][0]
            if at in path:
                continue
            best.append((-sum(nodes[m][3] or 0 for m in path), -len(path), leaf, [(nodes[m][1], nodes[m][2]) for m in reversed(path)]))
        out[c] = [b[3] for b in sorted(best, key=lambda b: b[:3])]
    return out


def trees():
    rng = random.Random(9)
    rows = []
    for c in range(12):
        for m in range(1, rng.randint(2, 14)):
            p = rng.choice([None, *range(1, m)]) if m > 1 else None
            rows.append((c, m, p, rng.choice(["user", "assistant"]), f"t{c}-{m} </turn> \\b <turn role=\"x\">", float(rng.randrange(4))))
    rows += [(50, k, k - 1 if k else None, "assistant" if k % 2 else "user", f"x{k}", 1.0) for k in range(70)]
    rows += [(51, 1, 77, None, None, None), (52, 1, 2, "user", "loop", 1.0), (52, 2, 1, "user", "loop", 1.0), (52, 3, None, "user", "a", None), (53, None, None, "user", "no id", 1.0), (54, 1, None, "r", "a", 1.0), (54, 1, None, "r", "a", 1.0)]
    return rows + [(None, 1, None, "user", "null conversation", 1.0), (None, 2, 1, "assistant", "yes", 1.0)]


@pytest.mark.parametrize("branches", [1, 3])
def test_reply_paths(spark, branches):
    rows = trees()
    df = spark.createDataFrame(rows, "conv_id bigint, msg_id bigint, parent_id bigint, role string, text string, score double")
    out = chat.format_paths(chat.reply_paths(clashing(df), branches))
    got = {}
    for r in out.select("conv_id", "branch", chat.read_turns(F.col("formatted")).alias("t"), chat.read_learnt(F.col("formatted"), F.col("turn_starts"), F.col("loss")).alias("l"), "formatted", "loss").collect():
        got[r.conv_id, r.branch] = [tuple(t) for t in r.t]
        assert r.l == [t.text for t in r.t if t.role == "assistant"]
        spans = [r.formatted[x.start : x.stop] for x in r.loss if x]
        assert len(spans) == len(r.l) and all("<" not in s for s in spans)
    want = {(c, b + 1): [(role or "", text or "") for role, text in path] for c, paths in plain_best(rows).items() for b, path in enumerate(paths[:branches])}
    assert got == want


def test_escapes_are_reversible(spark):
    texts = ["", "\\", "\\\\b", "\\l<\\", "</turn>\n", '<turn role="user">', '"\\q"', "\\b\\l\\q", "plain"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("back")).collect():
        assert r.back == r.t and "<" not in r.e and '"' not in r.e


def test_linear_conversations(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", None), (1, 1, "assistant", None), (1, None, None, "first"), (2, 5, "assistant", "only")]
    out = chat.format_paths(chat.reply_paths(chat.linear_replies(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))))
    got = {r.conv_id: [tuple(t) for t in r.t] for r in out.select("conv_id", chat.read_turns(F.col("formatted")).alias("t")).collect()}
    assert got == {1: [("", "first"), ("user", "a"), ("assistant", ""), ("assistant", "")], 2: [("assistant", "only")]}
    none = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.format_paths(chat.reply_paths(chat.linear_replies(none))).count() == 0


