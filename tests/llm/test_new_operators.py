"""Licence scans, alignment of tokenizers and the filter audit, against brute force."""

import hashlib
import random
from collections import Counter, defaultdict
from itertools import permutations

import pytest

from storyline.llm import align, audit, licences
from storyline.llm import queries as q
from storyline.llm.licence_texts import TEMPLATES
from tests.llm.test_operators import ODD, documents, written


# ---- licence scans


def plain_words(t):
    out, run = [], ""
    for c in (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) + " ":
        if c in "abcdefghijklmnopqrstuvwxyz0123456789" or ord(c) >= 0x80:
            run += c
        elif run:
            out.append(run)
            run = ""
    return out


def plain_places(w, phrases):
    out = []
    for label, phrase in phrases.items():
        p = phrase.split()
        out += [(label, i, i + len(p)) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    return sorted(out, key=lambda x: (x[1], x[0]))


def plain_anchors(w, templates):
    """Maximal common runs of the words and each template by comparing all places."""
    out = set()
    for t, said in enumerate(templates):
        for i in range(len(w)):
            for j in range(len(said)):
                n = 0
                while i + n < len(w) and j + n < len(said) and w[i + n] == said[j + n]:
                    n += 1
                if n:
                    out.add((t, i, j, n))
    return out


def licence_texts(seed, n):
    r = random.Random(seed)
    said = [t.split() for t in TEMPLATES.values()] + [p.split() for p in licences.PHRASES.values()]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(r.randint(0, 5)):
            w = list(r.choice(said))
            a = r.randrange(len(w))
            w = w[a : a + r.randint(1, 40)] if r.random() < 0.5 else w
            w = [x for x in w if r.random() > 0.04]
            w = [r.choice(["the", "of", "zzz", "license"]) if r.random() < 0.04 else x for x in w]
            parts.append(r.choice([" ", "\n", ", ", "-"]).join(w))
            parts.append(" ".join(r.choice(["the", "license", "mit", "apache", "x1", "ü", "general", "public"]) for _ in range(r.randint(0, 9))))
        out.append(" ".join(parts))
    return out


def test_licence_statistics_equal_plain_matching():
    """A run ends where the next word does not make it longer; runs inside others of the same end are not maximal to the left."""
    automaton = licences.Automaton(TEMPLATES, licences.PHRASES)
    templates = [[x.decode() for x in licences.words(t.encode())] for t in TEMPLATES.values()]
    for text in licence_texts(1, 60):
        w = plain_words(text)
        assert [x.decode() for x in licences.words(text.encode())] == w
        longest = [0] * (len(w) + 1)  # matching statistics by all places
        for _, i, _, n in plain_anchors(w, templates + [p.split() for p in licences.PHRASES.values()]):
            for k in range(1, n + 1):
                longest[i + k] = max(longest[i + k], k)
        state = length = 0
        for k, x in enumerate(w):
            state, length = automaton.step(state, length, automaton.word.get(x.encode(), -1))
            assert length == longest[k + 1]
        reader = licences.Reader(automaton)
        for at in range(0, len(w), 7):  # piece by piece
            reader.read([x.encode() for x in w[at : at + 7]])
        reader.close(reader.n)
        got = {(t, d, p, n) for t, d, p, n in reader.anchors if n >= licences.LEAST_RUN}
        # Longest runs ending at a word, that no longer run goes on from.
        ends = {k: longest[k] for k in range(1, len(w) + 1) if longest[k] and (k == len(w) or longest[k + 1] <= longest[k])}
        want = set()
        for t, said in enumerate(templates):
            for k, n in ends.items():
                if n >= licences.LEAST_RUN:
                    want |= {(t, k - n, j, n) for j in range(len(said) - n + 1) if said[j : j + n] == w[k - n : k]}
        assert got == want
        assert sorted(reader.base, key=lambda x: (x[1], x[0])) == plain_places(w, licences.PHRASES)


def test_licences_of_odd_texts(spark, tmp_path):
    filler = "zzz " * 400
    whole = {label: text for label, text in TEMPLATES.items()}
    texts = ODD + licence_texts(2, 60) + [f"{filler} {t} {filler}" for t in whole.values()] + ["mit license " * 5000, "é" * 300_000 + " MIT-License", "MİT License"]
    d = written(spark, tmp_path, documents=documents(spark, texts))
    got = {x.doc_id: x for x in q.op11_licences(spark, d).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        w = plain_words(t)
        base = plain_places(w, licences.PHRASES)
        x = got[i]
        assert (x.n_words, x.n_base, x.base_labels) == (len(w), len(base), ",".join(sorted({b[0] for b in base})))
        assert (x.first_word, x.last_word) == ((base[0][1], max(b[1] for b in base)) if base else (None, None))
        assert set(x.base_labels.split(",")) <= set(x.labels.split(",")) | {""} and 0 <= x.score <= 1
        assert (x.score > 0) == (x.labels != "")
    first = len(ODD) + 60
    for k, label in enumerate(whole):
        assert label.split("|")[0] in got[first + k].labels.split(","), label
    assert all(got[i].labels == "" for i in range(len(ODD)))
    assert q.op11_licences(spark, written(spark, tmp_path / "none", documents=documents(spark, ["x"]).limit(0))).count() == 0


def test_licence_spans_survive_changed_words(spark):
    w = TEMPLATES["mit|text"].split()
    changed = [x for k, x in enumerate(w) if k % 23 != 7]
    changed[40] = "other"
    docs = documents(spark, [" ".join(["filler"] * 30 + changed + ["filler"] * 30), " ".join(w[:30]), "the software is provided to any person of the state"])
    spans = {x.doc_id: x.spans for x in licences.scan(docs).collect()}
    assert [(s.label, s.start, s.end) for s in spans[0]] == [("mit", 30, 30 + len(licences.words(" ".join(changed).encode())))]
    assert 0.7 <= spans[0][0].share < 1
    assert not spans[1] and not spans[2]


# ---- alignment


def plain_groups(a, b):
    """Groups as lists of places and all overlapping pairs of places, from byte offsets."""
    ends = lambda s: [sum(map(len, s[: k + 1])) for k in range(len(s))]
    ea, eb = ends(a), ends(b)
    links = [(i, j) for i in range(len(a)) for j in range(len(b)) if max(ea[i] - len(a[i]), eb[j] - len(b[j])) < min(ea[i], eb[j])]
    groups, ga, gb = [], [], []
    cuts = set(ea) & set(eb)
    i = j = 0
    for c in sorted(cuts):
        ga, gb = [k for k in range(i, len(a)) if ea[k] <= c], [k for k in range(j, len(b)) if eb[k] <= c]
        i, j = i + len(ga), j + len(gb)
        groups.append((ga, gb))
    return groups, links


def brute_alignment(texts):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    from storyline.llm.bpe import byte_letters

    ta = Tokenizer.from_file(public_tokenizers.path(q.BYTE_BPE))
    ta.encode_special_tokens = True
    tb = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(q.PIECE_BPE))
    letters = byte_letters()
    rows, count = [], Counter()
    for t in texts:
        ia, ib = (ta.encode(" " + t, add_special_tokens=False).ids, tb.encode(t)) if t else ([], [])
        a = [bytes(letters[c] for c in ta.id_to_token(i)) for i in ia]
        b = [bytes([int(p[3:5], 16)]) if p.startswith("<0x") and p.endswith(">") and len(p) == 6 else p.replace("▁", " ").encode() for p in map(tb.id_to_piece, ib)]
        if not t or b"".join(a) != b" " + t.encode() or b"".join(b) != b" " + t.encode():
            rows.append(((), (), [], []))
            continue
        groups, links = plain_groups(a, b)
        links = [(ia[i], ib[j]) for i, j in links]
        count.update(links)
        rows.append((ia, ib, [([ia[k] for k in x], [ib[k] for k in y]) for x, y in groups], links))
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    out = []
    for ia, ib, groups, links in rows:
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((len(ia), len(ib), len(groups), len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links), hashlib.sha256(said.encode()).hexdigest() if said else "", said))
    return out


def aligned_texts():
    r = random.Random(8)
    return [
        None, "", " ", "a", "  two  spaces", "Ünï 🙂 code\n\n\ttabs", "<|endoftext|>x<s></s><unk><0x41>", "a▁b", "ﬁ Ａ é é", "日本語のテキスト", "the " * 300, "x" * 2000, "\x00\x01 nul",
        *("".join(r.choice(["the", "ing", "tion", " ", " ", "é", "🙂", "日", "\n", "q", "Z", "7", "  "]) for _ in range(r.randint(1, 60))) for _ in range(120)), "the cat", "the cat",
    ]


@pytest.mark.parametrize("most", [1 << 20, 40, 0])
def test_alignment_equals_byte_offsets(spark, most):
    texts = aligned_texts()
    want = brute_alignment(texts)
    assert sum(w[0] > 0 for w in want) > 100
    got = {x.doc_id: x for x in align.score(documents(spark, texts), q.tokenizer_path(), q.tokenizer_path(q.PIECE_BPE), most=most, spell=True).collect()}
    assert len(got) == len(texts)
    for i, w in enumerate(want):
        x = got[i]
        assert (x.n_a, x.n_b, x.n_groups, x.n_links, x.n_best, x.count_sum, x.groups_sha256, x.groups) == w, texts[i]


def test_alignment_query_of_the_whole_table(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("n_chars < 1500")
    rows = docs.select("doc_id", "text").collect()
    d = written(spark, tmp_path, documents=docs)
    got = {x.doc_id: tuple(x)[1:] for x in q.op12_align(spark, d).collect()}
    assert got == {r.doc_id: w[:7] for r, w in zip(rows, brute_alignment([r.text for r in rows]), strict=True)}
    empty = written(spark, tmp_path / "none", documents=docs.limit(0))
    assert q.op12_align(spark, empty).count() == 0


def test_transducer_forgets_and_goes_on(monkeypatch):
    monkeypatch.setattr(align, "MOST_STEPS", 3)
    t = align.Transducer([b"ab", b"c", b"abc", b"x"], [b"a", b"bc", b"b", b"c", b"y"])
    for _ in range(3):
        assert [s == 0 for s in t.run([0, 1], [0, 1])] == [False, False, True]  # ab-a, ab-bc, c-bc
        assert t.run([2], [0, 2, 3])[-1] == 0
        assert t.run([3], [4]) is None and t.run([0], [0]) is None and t.run([], []) == []
        assert t.run([0, 1, 3], [0, 1]) is None and t.run([0, 1], [0, 1, 4]) is None and t.run([3], []) is None and t.run([], [4]) is None


# ---- filter audit


def brute_audit(docs, labels):
    """docs: (doc_id, source, text) rows; labels: (doc_id, quality, toxic) rows."""
    good, toxic = {i for i, x, _ in labels if x == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    least = {}
    for i, _, t in docs:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    rows = []
    for i, s, t in docs:
        t = t or ""
        w = [x for x in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in t).split(" ") if x]
        fails = {
            "A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": i is not None and t in least and least[t] < i,
        }
        rows.append((s or "", {f for f, x in fails.items() if x}, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = list(mine)
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                shapley[f] += len(gone)
                fails = [r for r in mine if f in r[1]]
                out[part, "".join(order), step] = [len(left), len(gone), len(fails) - len(gone), sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                out[part, "".join(order), step].append(shapley[f])
    return out


@pytest.mark.parametrize("parts", [4, 37])
def test_audit_equals_plain_filters(spark, parts):
    r = random.Random(parts)
    said = [None, "", " \t", "A B", "x" * 5000, "a|b", "W " * 60, " nbsp wide\x1cfs " * 60, *(" ".join(r.choice(["a", "B", "c#", "dog"] + [f"w{k}" for k in range(80)]) for _ in range(r.randint(1, 120))) for _ in range(60))]
    docs = [(r.choice([None, *range(300)]), r.choice([None, "", "s1", "s2"]), r.choice(said)) for _ in range(400)]
    docs += [(i, "hot", "one text of many copies") for i in range(500, 1500)] + [(None, "hot", "one text of many copies")] * 30 + [(500, "hot", "one text of many copies")] * 200
    labels = [(r.randrange(300), r.choice([None, 0, 1]), r.choice([None, 0, 1])) for _ in range(200)] + [(None, 1, 1)] + [(i, 1, 1) for i in range(500, 600)]
    df = spark.createDataFrame([(i, t, s, 0, "x", True) for i, s, t in docs], "doc_id long, text string, source string, mask int, part string, edge boolean").repartition(5)
    lab = spark.createDataFrame([(*x, "y") for x in labels], "doc_id long, quality int, toxic int, part string")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = audit.audit(df, lab).collect()
        ranges = audit.failures(df).filter("edge").count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert ranges > parts  # the hot text is at the edges of several ranges
    assert {(x.part, x.filter_order, x.step): [x.kept, x.removed, x.redundant, x.unique_fails, x.good_lost, x.toxic_lost, x.shapley] for x in got} == brute_audit(docs, labels)
    assert len(got) == 600 * len({x.part for x in got})
    assert audit.audit(df.limit(0), lab).count() == 0
    assert audit.audit(df, lab.limit(0)).agg({"good_lost": "sum"}).first()[0] == 0
