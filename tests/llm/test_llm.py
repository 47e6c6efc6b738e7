"""Runs, matching, tokens, leaks and subjects: defined cases, hand-made ones, brute force, round trips and held-out labels."""

import math
import os
import random

import numpy as np
import pytest

from pathloom.llm import leaks, matching, sentences, subjects, tokens, words
from pathloom.llm.fmindex import FMIndex, suffix_array
from pathloom.llm.lexicon import Lexicon, compile_words
from pathloom.llm.runs import collapse_runs

TOKENIZERS = os.environ.get("PATHLOOM_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"


class TestRuns:
    SCHEMA = "rec bigint, pos int, link bigint, fwd boolean, t bigint, chunk string"

    def runs(self, spark, data, **kw):
        df = spark.createDataFrame(data, self.SCHEMA).selectExpr("rec", "pos", "link", "fwd", "timestamp_seconds(t) as at", "chunk")
        got = collapse_runs(df, "rec", "pos", "link", "fwd", "at", 300, **kw)
        return sorted((r["rec"], r["first_pos"], r["last_pos"], r["n"]) for r in got.collect())

    def brute(self, data):
        out = []
        for rec in sorted({d[0] for d in data if d[0] is not None}):
            fwd, prev = None, None
            for _, pos, link, f, t, _ in sorted({d for d in data if d[0] == rec and d[1] is not None and d[2] is not None}, key=lambda d: d[1]):
                fwd = f if f is not None else fwd
                if prev and prev[0] == (link, fwd) and t - prev[1] <= 300:
                    out[-1][2] = pos
                    out[-1][3] += 1
                else:
                    out.append([rec, pos, pos, 1])
                prev = ((link, fwd), t)
        return sorted(map(tuple, out))

    @pytest.mark.parametrize("chunk", [65536, 16, 3])
    def test_against_brute_force(self, spark, chunk):
        rnd = random.Random(6)
        data, t = [], 0
        for rec in (1, 2, 3):
            for pos in range(120):
                t += rnd.choice([5, 60, 300, 301])
                data.append((rec, pos, rnd.choice([None, 7, 7, 7, 8]), rnd.choice([None, True, True, False]), t, "x"))
        data += data[:30]
        rnd.shuffle(data)
        assert self.runs(spark, data, chunk=chunk) == self.brute(data)

    def test_defined_cases(self, spark):
        assert self.runs(spark, []) == []
        assert self.runs(spark, [(None, 1, 1, True, 0, ""), (1, None, 1, True, 0, ""), (1, 1, None, True, 0, "")]) == []
        assert self.runs(spark, [(1, 1, 5, None, 0, ""), (1, 2, 5, None, None, ""), (1, 3, 5, True, 10, "")]) == [(1, 1, 2, 2), (1, 3, 3, 1)]

    def test_batches_of_arrow_join(self, spark):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        try:
            assert self.runs(spark, [(1, i, 5, True, i, "") for i in range(100)]) == [(1, 0, 99, 100)]
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


class TestLexicon:
    def test_round_trip_and_sharing(self, tmp_path):
        rnd = random.Random(7)
        entries = {bytes(rnd.choice(b"abcd") for _ in range(rnd.randrange(1, 8))): tuple(rnd.randrange(70_000) for _ in range(rnd.randrange(0, 4))) for _ in range(400)}
        path = tmp_path / "lexicon"
        path.write_bytes(compile_words(sorted(entries.items())))
        found = Lexicon(str(path))
        assert all(tuple(found.get(w)) == ids for w, ids in entries.items())
        assert all((found.get(w) is None) == (w not in entries) for w in (bytes(rnd.choice(b"abcde") for _ in range(4)) for _ in range(500)))
        # suffixes are shared: a second word of the same ending only adds an arc
        one = len(compile_words([(b"walking", (1,))]))
        both = len(compile_words([(b"talking", (2,)), (b"walking", (1,))]))
        assert both - one < 60

    def test_empty(self, tmp_path):
        path = tmp_path / "lexicon"
        path.write_bytes(compile_words([]))
        assert Lexicon(str(path)).get(b"a") is None


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="the vocabulary isn't here")
class TestTokens:
    TEXTS = ["Hello  world, it's 3.14\n\n done", "", None, "   ", "x" * 5000, "ab" * 3000 + "!", "漢字かな 한국어 ทาง 🚲💨", "<|endoftext|> İstanbul ſß", "﻿\x07​ tab\t", "Walking walking walking"]

    def test_equals_the_library(self, spark):
        tokenizers = pytest.importorskip("tokenizers")
        t = tokenizers.Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
        t.encode_special_tokens = True
        rnd = random.Random(8)
        more = ["".join(rnd.choice("ab é'st\n 12中") for _ in range(rnd.randrange(60))) for _ in range(200)]
        texts = self.TEXTS + more
        df = spark.createDataFrame([(i, x, "e") for i, x in enumerate(texts)], "id bigint, text string, ids string")
        got = dict(tokens.encode_corpus(df, "id", "text", VOCABULARY).select("id", "ids").collect())
        for i, x in enumerate(texts):
            assert got[i] == t.encode(x or "", add_special_tokens=False).ids

    def test_empty_table_and_repeats(self, spark):
        df = spark.createDataFrame([], "id bigint, text string")
        assert tokens.encode_corpus(df, "id", "text", VOCABULARY).count() == 0
        df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a")], "id bigint, text string")
        assert tokens.encode_corpus(df, "id", "text", VOCABULARY).count() == 3

    def test_merge_decodes(self):
        ranks = tokens.read_ranks(VOCABULARY)
        back = {v: k for k, v in ranks.items()}
        for w in ("unseen", "ö" * 300, "aaaaaaaaab", " zzyzx"):
            assert b"".join(back[i] for i in tokens.merge(w.encode(), ranks)) == w.encode()


class TestFMIndex:
    def test_against_brute_force(self):
        rnd = np.random.default_rng(9)
        for sigma in (2, 5, 300):
            text = rnd.integers(1, sigma + 1, 700)
            index = FMIndex(text, every=7)
            for n in (1, 2, 3, 5):
                phrases = np.vstack([[text[i : i + n] for i in rnd.integers(0, 690, 40)], rnd.integers(1, sigma + 3, (10, n))])
                lo, hi = index.search(phrases)
                for p, a, b in zip(phrases, lo, hi):
                    want = [i for i in range(len(text) - n + 1) if (text[i : i + n] == p).all()]
                    assert sorted(index.locate(np.arange(a, b)).tolist()) == want

    def test_suffix_array_of_repeats(self):
        text = np.array([1] * 200 + [0])
        assert suffix_array(text).tolist() == list(range(200, -1, -1))


PASSAGE = "On Friday 3 May the counter at Brorton logged 655 riders by 18:14, 46 of them under umbrellas, whereas Kaiberg saw 225. Box 526 held 23 bells."
OTHER = "On Monday 9 June the counter at Velden logged 121 riders by 7:02, 13 of them in wet gloves, whereas Tamath saw 88. Box 77 held 4 bells."


class TestLeaks:
    def found(self, spark, texts, items=(PASSAGE,), **kw):
        docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "id bigint, text string, item bigint")
        tests = spark.createDataFrame([(i + 100, f"Answer in one word.\n{t}" if t else t) for i, t in enumerate(items)], "item bigint, text string")
        return {(r["id"], r["item"]) for r in leaks.leaked_items(docs, "id", "text", tests, "item", "text", **kw).select("id", "item").collect()}

    def test_forms(self, spark):
        w = PASSAGE.split()
        quoted = PASSAGE.replace("logged 655 riders", "log-\n> ged 655\n> riders").replace("umbrellas", "umbrel-\r\n> las")
        forms = [
            PASSAGE.upper(), f"<p>Well.</p><p>{PASSAGE}</p>", f"> {quoted}", " ".join(w[3:16]), PASSAGE.replace("o", "о").replace("e", "e​"),
            " ".join(w[:5] + ["maybe"] + w[5:11] + w[12:20] + ["roughly"] + w[20:]), "x " * 500 + PASSAGE,
        ]
        assert self.found(spark, forms) == {(i, 100) for i in range(len(forms))}

    def test_no_cases(self, spark):
        w = PASSAGE.split()
        assert self.found(spark, [None, "", "Answer in one word.", OTHER, " ".join(w[:8]), " ".join(w[4:11]) + " and so on", "!!!", PASSAGE[::-1]]) == set()

    def test_items_apart_and_passes(self, spark, monkeypatch):
        docs = [PASSAGE + " " + OTHER, OTHER, PASSAGE]
        want = {(0, 100), (0, 101), (1, 101), (2, 100)}
        assert self.found(spark, docs, (PASSAGE, OTHER, None, "", "isn't there")) == want
        monkeypatch.setattr(leaks, "PASS_BYTES", 100)
        assert self.found(spark, docs, (PASSAGE, OTHER), shard_words=20) == want

    def test_short_items(self, spark):
        """A passage of a word or two is found where all of it stands."""
        docs = ["alpha", "it said: Zebra-crossing closed!", "crossing zebra closed", "blue tram stop here", "tram blue stop", "the zebra"]
        assert self.found(spark, docs, ("Alpha", "zebra crossing", "Blue tram stop", "-")) == {(0, 100), (1, 101), (3, 102)}

    def test_spans_are_apart(self, spark):
        """An item at both ends of a long text gives two spans, and what lies between stays."""
        n = len(words.words_of(PASSAGE))
        docs = spark.createDataFrame([(1, f"{PASSAGE} {'nothing here ' * 2500} {PASSAGE}"), (2, f"{PASSAGE} {PASSAGE}")], "id bigint, text string")
        tests = spark.createDataFrame([(7, PASSAGE)], "item bigint, text string")
        got = {r["id"]: [tuple(x) for x in r["spans"]] for r in leaks.leaked_items(docs, "id", "text", tests, "item", "text").collect()}
        assert got == {1: [(0, n - 1), (5000 + n, 5000 + 2 * n - 1)], 2: [(0, 2 * n - 1)]}

    def test_repeated_documents_and_clashing_columns(self, spark):
        docs = spark.createDataFrame([(1, PASSAGE, "a", 1.0), (1, PASSAGE, "a", 1.0), (None, PASSAGE, "b", 2.0)], "id bigint, text string, spans string, share double")
        tests = spark.createDataFrame([(7, PASSAGE, "x"), (7, PASSAGE, "x"), (None, PASSAGE, "y")], "item bigint, text string, doc string")
        got = leaks.leaked_items(docs, "id", "text", tests, "item", "text").collect()
        assert [(r["id"], r["item"], len(r["spans"])) for r in got] == [(1, 7, 1)]

    def test_common_phrase_is_passed_over(self):
        """A phrase that thousands of passages share is not among the searched ones, so its occurrences aren't multiplied by them."""
        rnd = random.Random(15)
        noise = ["".join(rnd.choice("bdfgklmn") + rnd.choice("aeiou") for _ in range(3)) for _ in range(2000)]
        said = [(i, " ".join([*rnd.sample(noise, 12), "which of these did the old rider say", *rnd.sample(noise, 12)])) for i in range(3000)]
        p = leaks.Passages(said)
        assert max(sizes.max() for _, sizes, _ in p.searched) < 20

    def test_recall_against_brute_force(self, spark):
        """Every copy with up to a fifth of its words changed, and every run of twelve, is found; the exact longest common subsequence is the judge."""
        rnd = random.Random(16)
        noise = ["".join(rnd.choice("bdfgklmn") + rnd.choice("aeiou") for _ in range(3)) for _ in range(400)]
        common = "the of and a to in that it is was for on".split()
        items = [" ".join(rnd.choice(common) if rnd.random() < 0.4 else rnd.choice(noise) for _ in range(rnd.randrange(10, 60))) for _ in range(40)]
        docs = []
        for i in range(160):
            w = items[i % 40].split()
            for _ in range(rnd.randrange(0, int(len(w) * 0.3) + 1)):
                at, kind = rnd.randrange(len(w)), rnd.random()
                w[at : at + 1] = [rnd.choice(noise)] if kind < 0.6 else [] if kind < 0.8 else [w[at], rnd.choice(common)]
            cut = rnd.randrange(0, len(w) // 2) if rnd.random() < 0.3 else 0
            docs.append(" ".join([*rnd.choices(noise + common * 8, k=30), *w[cut:], *rnd.choices(noise + common * 8, k=30)]))

        def holds(d, t):
            d, t = d.split(), t.split()
            best, row = 0, [0] * len(d)
            for x in t:  # longest run
                row = [(row[j - 1] if j else 0) + 1 if y == x else 0 for j, y in enumerate(d)]
                best = max([best, *row])
            if best >= min(12, len(t)):
                return True
            for a in range(0, len(d)):  # of a copy no longer than the passage and what is added to it
                window, line = d[a : a + len(t) + leaks.edits(len(t))], [0] * (len(t) + leaks.edits(len(t)) + 1)
                for x in t:
                    new = line[:]
                    for j, y in enumerate(window):
                        new[j + 1] = max(new[j], line[j + 1], line[j] + 1 if x == y else 0)
                    line = new
                if max(line) >= 0.8 * len(t):
                    return True
            return False

        want = {(i, 100 + k) for i, d in enumerate(docs) for k, t in enumerate(items) if len(set(d.split()) & set(t.split())) > 0.5 * len(set(t.split())) and holds(d, t)}
        got = self.found(spark, docs, items, shard_words=700)
        assert len(want) > 100 and len(want & got) >= 0.98 * len(want) and len(got - want) <= 0.03 * len(want)

    def test_empty_tables(self, spark):
        assert self.found(spark, []) == set() and self.found(spark, [PASSAGE], ()) == set()

    def test_fold(self):
        assert words.words_of("Tu&amp;rn <b>bo</b>ld fol-\r\n> ding Ｆｕｌｌ \\u0041b") == ["tu", "rn", "bold", "folding", "full", "ab"]


class TestSentences:
    def split(self, text):
        return [" ".join(s) for s in sentences.sentences_of(text)]

    def test_layouts_agree(self):
        a, b, c = "The bus was late again.", "Nobody said why it was late!", "We met there as usual."
        want = self.split(f"{a} {b} {c}")
        assert len(want) == 3
        assert self.split(f"<p>{a}</p><p>{b}</p><p>{c}</p>") == want == self.split(f"- {a}\n* {b}\n> {c}")
        assert self.split(f'0;a;"{a}"\r\n1;b;"{b}"\r\n2;c;"{c}"') == want
        assert self.split("The bus was\nlate again. Nobody said\nwhy it was late! We met\nthere as usual.") == want

    def test_edges(self):
        assert self.split(None) == self.split("") == self.split("​\n\n .") == []
        assert len(self.split("写真は後で送ります。来週また連絡します。")) == 2
        assert len(self.split("word " * 130)) == 10


class TestSubjects:
    NOUNS = {"sport": "peloton velodrome podium sprint".split(), "law": "statute plaintiff easement appeal".split()}

    def corpus(self, n=240):
        rnd = random.Random(10)
        docs, truth = [], {}
        for i in range(n):
            s = rnd.choice(["sport", "law", None])
            said = [f"Notes about the {rnd.choice(self.NOUNS[s])} and a {rnd.choice(self.NOUNS[s])} again." if s else "Nothing else was said." for _ in range(6)]
            said += ["Thanks to all who came here."] * 2
            if rnd.random() < 0.3:
                said.append(f"Somebody mentioned a {rnd.choice(self.NOUNS['law'] + self.NOUNS['sport'])} in passing.")
            docs.append((i, " ".join(said), "x"))
            truth[i] = s
        return docs, truth

    def run(self, spark, docs, labels, **kw):
        d = spark.createDataFrame(docs, "id bigint, text string, subject string")
        s = spark.createDataFrame([("sport", "Sport", "races and the peloton"), ("law", "Law", "courts and the statute"), (None, None, None)], "subject string, title string, scope string")
        lab = spark.createDataFrame(labels, "id bigint, subject string")
        return subjects.subject_areas(d, "id", "text", s, lab, least_count=2, **kw)

    def test_held_out(self, spark):
        docs, truth = self.corpus()
        labels = [(i, truth[i] or "none") for i in range(60)] + [(3, "none"), (9999, "sport"), (None, "law"), (5, None)]
        got = {r["id"]: r["subject"] for r in self.run(spark, docs + docs[:4], labels).collect()}
        right = sum(got.get(i) == truth[i] for i in range(60, len(docs)))
        assert right >= 0.97 * (len(docs) - 60)

    def test_updates_bring_words_no_label_knows(self, spark, monkeypatch):
        """A few labels name a few of each subject's words; the alternating passes find the others by the company they keep."""
        rnd = random.Random(12)
        known = {s: ["".join(rnd.choice("bdfgklmnprstaeiou") for _ in range(8)) for _ in range(150)] for s in ("sport", "law")}
        docs, truth = [], {}
        for i in range(900):
            s = rnd.choice(["sport", "law", None])
            said = [f"Notes about {rnd.choice(known[s])} and {rnd.choice(known[s])} with {rnd.choice(known[s])} again." if s else "Nothing else was said." for _ in range(4)]
            docs.append((i, " ".join([*said, "Thanks to all who came here.", "More about this next week."]), "x"))
            truth[i] = s
        labels = [(i, truth[i] or "none") for i in range(18)]
        recall = {}
        for passes in (0, subjects.PASSES):
            got = {r["id"]: r["subject"] for r in self.run(spark, docs, labels, passes=passes).collect()}
            held = [i for i in range(18, len(docs)) if truth[i]]
            recall[passes] = sum(got.get(i) == truth[i] for i in held) / len(held)
            assert all(truth[i] == s for i, s in got.items())
        assert recall[subjects.PASSES] >= 0.95 and recall[subjects.PASSES] >= recall[0] + 0.1, recall

    def test_sums_in_a_tree(self, spark):
        """However many tasks and levels, the sum is that of all blocks."""
        import pandas as pd

        rnd = np.random.default_rng(13)
        docs = spark.createDataFrame([(i, " ".join(f"word{chr(97 + x)} here" for x in rnd.integers(0, 20, 9)) + ".") for i in range(300)], "doc bigint, text string")
        blocks = docs.repartition(23).mapInPandas(subjects._matrix_rows, subjects._MATRIX.format("bigint")).persist()
        counts = pd.concat([pd.DataFrame({"t": np.frombuffer(r["distinct"], np.int64), "n": np.frombuffer(r["counts"], np.int32)}) for r in blocks.collect()]).groupby("t")["n"].sum()
        shared = spark.sparkContext.broadcast(counts.index.to_numpy())
        n = len(counts)
        for fan_in in (2, 5, 32):
            assert (subjects._summed(blocks, lambda m: np.bincount(m.cols, minlength=n), shared, n, fan_in) == counts.to_numpy()).all()

    def test_where_updates_begin_makes_no_difference(self):
        """The mixtures for given components are those that more updates would reach, so they need not be kept from pass to pass."""
        rnd = np.random.default_rng(14)
        weights = rnd.random((3, 40)) ** 4
        h = subjects.anchored(weights / weights.sum(axis=0), rnd.integers(5, 50, 40).astype(float))
        rows = np.repeat(np.arange(60), 12)
        m = subjects.Matrix(rows, rnd.integers(0, 40, len(rows)), np.arange(60), list(range(60)))
        enough, longer = subjects.verdicts(subjects.mixtures(m, h, 3)), subjects.verdicts(subjects.mixtures(m, h, 3, rounds=2000))
        assert (enough[1] == longer[1]).mean() >= 0.95 and (enough[0] == longer[0])[longer[1]].mean() >= 0.95

    def test_defined_cases(self, spark):
        assert self.run(spark, [], []).count() == 0
        assert self.run(spark, [(1, None, ""), (2, "", ""), (None, "Notes about the peloton again.", "")], [(1, "sport")]).count() == 0


class TestMatching:
    A = "id bigint, name string, kind string, lon double, lat double, feet double"
    B = "id bigint, n1 string, n2 string, k1 string, k2 string, lon double, lat double, feet double"

    def match(self, spark, a, b):
        x = matching.encode_records(spark.createDataFrame(a, self.A), "id", ["name"], ["kind"], "lon", "lat", "feet", 0.3048)
        y = matching.encode_records(spark.createDataFrame(b, self.B), "id", ["n1", "n2"], ["k1", "k2"], "lon", "lat", "feet", 0.3048)
        return {(r["a_id"], r["b_id"]) for r in matching.match_records(x, y).where("confidence >= 0.5").collect()}

    def test_cases(self, spark):
        a = [
            (1, "Oskel Road", "bike lane", 0.0, 40.0, 1000.0), (2, "Oskel Lane", "cycletrack", 0.0005, 40.0, 500.0), (3, None, "sharrow", 0.1, 40.0, 800.0), (4, "Velda Path", "multi use path", 0.2, 40.0, 500.0),
            (5, "Velda Path", "multi use path", 0.2008, 40.0, 500.0), (6, "Velda Path", "multi use path", 0.21, 40.0, 900.0), (7, None, None, None, 40.0, 1.0), (None, "Oskel Road", "bike lane", 0.0, 40.0, 1000.0),
        ]
        b = [
            (11, "THE OKSEL RD.", None, "bike lane", None, 0.0001, 40.0001, 1040.0), (12, None, None, None, "sharrow", 0.1001, 40.0, 780.0), (13, "Path, Velda", "Velda Pth Ph 2", "multi use path", None, 0.2004, 40.0, 1000.0),
            (11, "THE OKSEL RD.", None, "bike lane", None, 0.0001, 40.0001, 1040.0),
        ]
        assert self.match(spark, a, b) == {(1, 11), (3, 12), (4, 13), (5, 13)}

    def test_empty(self, spark):
        assert self.match(spark, [], []) == set() == self.match(spark, [(1, "Oskel Road", "bike lane", 0.0, 40.0, 1000.0)], [])

    def test_hashing_is_exact(self, spark):
        """All pairs within the radius are found, whatever their bits."""
        rnd = random.Random(11)
        base = rnd.getrandbits(matching.NAME_BITS)
        codes = [base ^ sum(1 << i for i in rnd.sample(range(matching.NAME_BITS), rnd.randrange(0, 16))) for _ in range(60)]
        schema = "id bigint, lon double, lat double, metres double, codes array<bigint>, letters array<bigint>, kinds array<string>, classes array<string>"
        make = lambda o: spark.createDataFrame([(i + o, 0.0, 40.0, 100.0, [c], [0], [""], ["x"]) for i, c in enumerate(codes)], schema)
        got = {(r[0], r[1] - 1000) for r in matching.candidates(make(0), make(1000)).collect()}
        assert got == {(i, j) for i, c in enumerate(codes) for j, d in enumerate(codes) if (c ^ d).bit_count() <= matching.NAME_RADIUS}

    def records(self, spark, rows, o=0):
        schema = "id bigint, lon double, lat double, metres double, codes array<bigint>, letters array<bigint>, kinds array<string>, classes array<string>"
        return spark.createDataFrame([(i + o, lon, lat, m, [matching.name_code(n)] if n else [], [matching.letter_code(n)] if n else [], [""] if n else [], ["path"]) for i, (lon, lat, m, n) in enumerate(rows)], schema)

    def test_length_codes(self, spark):
        """Codes of lengths are two bits apart for each step between them."""
        df = self.records(spark, [(0.0, 0.0, 1.057 ** (k + 0.5), None) for k in range(0, 140)])
        got = {r["id"]: r["code"] for r in matching._sized(df).select("id", "code").collect()}
        for i in range(140):
            for j in range(i, min(140, i + 31)):
                assert (got[i] ^ got[j]).bit_count() == 2 * (j - i)

    def test_recall_of_candidates_against_brute_force(self, spark):
        """All pairs that the rule of nearness allows are found, at the antimeridian, near the pole and across sizes alike."""
        rnd = random.Random(17)
        rows = []
        for lon, lat in ((0.0, 40.0), (179.9995, -20.0), (-179.9995, -20.0), (10.0, 88.9), (-60.0, 0.0)):
            for _ in range(60):
                rows.append((((lon + rnd.gauss(0, 0.004) + 540) % 360) - 180, lat + rnd.gauss(0, 0.003), 10 ** rnd.uniform(1, 5.9), rnd.choice(["oskel", "oskle", "velda", None])))
        rows.append((20.0, 89.0, 1e9, "oskel"))
        half = len(rows) // 2
        rnd.shuffle(rows)
        a, b = rows[:half], rows[half:]

        def apart(p, q):
            x, y = math.radians(p[1]), math.radians(q[1])
            h = math.sin((y - x) / 2) ** 2 + math.cos(x) * math.cos(y) * math.sin(math.radians(q[0] - p[0]) / 2) ** 2
            return 2 * matching.EARTH_M * math.asin(math.sqrt(min(1, h)))

        step = lambda m: math.floor(math.log(m) / math.log(matching.LENGTH_STEP))
        want = set()
        for i, p in enumerate(a):
            for j, q in enumerate(b):
                d = apart(p, q)
                named = p[3] and q[3] and (matching.name_code(p[3]) ^ matching.name_code(q[3])).bit_count() <= matching.NAME_RADIUS and d <= 60 + abs(p[2] - q[2]) / 2
                sized = not (p[3] and q[3]) and abs(step(p[2]) - step(q[2])) <= 4 and d <= 60
                if named or sized:
                    want.add((i, j + 1000))
        got = set(map(tuple, matching.candidates(self.records(spark, a), self.records(spark, b, 1000)).collect()))
        assert got == want and len(want) > 300

    def test_one_record_at_the_pole_changes_nothing(self, spark):
        rnd = random.Random(18)
        rows = [(rnd.gauss(0, 0.01), 40 + rnd.gauss(0, 0.01), rnd.uniform(100, 900), rnd.choice(["oskel", "velda", "brorow"])) for _ in range(150)]
        one = matching.candidates(self.records(spark, rows[:70]), self.records(spark, rows[70:], 1000))
        two = matching.candidates(self.records(spark, rows[:70]), self.records(spark, [*rows[70:], (0.0, 89.0, 500.0, "oskel")], 1000))
        assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))

    def test_confidence_is_what_it_says(self, spark):
        """Of planted pairs: matches with noise in each field, and others; in each band of confidence about so many are matches as it says."""
        rnd = random.Random(19)
        syllables = [c + v for c in "bdfgklmnprst" for v in "aeiou"]
        a, b, truth = [], [], set()
        for i in range(500):
            name = "".join(rnd.choice(syllables) for _ in range(3))
            lon, lat, feet = rnd.uniform(-0.05, 0.05), 40 + rnd.uniform(-0.05, 0.05), rnd.uniform(400, 3000)
            a.append((i, f"{name} Road", "bike lane", lon, lat, feet))
            if rnd.random() < 0.7:
                k = rnd.randrange(len(name) - 1)
                spelt = name if rnd.random() < 0.7 else name[:k] + name[k + 1] + name[k] + name[k + 2 :]
                b.append((1000 + i, f"{spelt} Rd" if rnd.random() < 0.8 else spelt, None, rnd.choice(["bike lane"] * 3 + ["sharrow"]), None, lon + rnd.gauss(0, 1e-4), lat + rnd.gauss(0, 1e-4), feet * rnd.uniform(0.9, 1.1)))
                truth.add((i, 1000 + i))
            else:  # another street close by, of a like name or of the same name and another kind
                other = name[:-2] + rnd.choice(syllables)
                b.append((1000 + i, f"{other} Road" if rnd.random() < 0.5 else f"{name} Lane", None, "sharrow", None, lon + 5e-4, lat, feet * rnd.uniform(0.3, 3)))
        x = matching.encode_records(spark.createDataFrame(a, self.A), "id", ["name"], ["kind"], "lon", "lat", "feet", 0.3048)
        y = matching.encode_records(spark.createDataFrame(b, self.B), "id", ["n1", "n2"], ["k1", "k2"], "lon", "lat", "feet", 0.3048)
        got = [(r["confidence"], (r["a_id"], r["b_id"]) in truth) for r in matching.match_records(x, y).collect()]
        assert sum(hit for c, hit in got if c >= 0.5) >= 0.95 * len(truth)
        for low, high in ((0.0, 0.2), (0.8, 1.01)):
            band = [(c, hit) for c, hit in got if low <= c < high]
            assert len(band) >= 30 and abs(sum(c for c, _ in band) / len(band) - sum(hit for _, hit in band) / len(band)) < 0.1

    def test_names(self):
        assert matching.name_parts("Conn, N. Urvora - Phase I") == ("urvora", "connector")
        assert matching.name_parts("Oskinam Green Way") == ("oskinam", "greenway")
        assert matching.name_parts(None) == ("", None)
