"""Phrases, chat text and manifests against plain versions."""

import hashlib
import random
import re
from collections import Counter

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linelake.llm import chat, merkle, phrases
from tests.compare import duck, same
from tests.llm.data import awkward


def test_queries_agree_with_sql(spark, sf):
    from linelake.llm.queries import ORACLE, QUERIES

    con = duck(sf)
    for name in ("op11_phrase_mining", "op12_chat_formatting", "op13_merkle_manifest"):
        same(QUERIES[name](spark, sf), con, ORACLE[name])


# phrases


def phrases_by_force(rows, deepest, least, top):
    n, f = Counter(), Counter()
    for lang, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(w)
            for d in range(1, deepest + 1):
                f.update((lang or "und", *w[i : i + d]) for i in range(len(w) - d + 1))
    much = {k: v for k, v in f.items() if v >= least and len(k) > 2}
    inner = set()
    for k, v in much.items():
        for d in range(2, len(k) - 1):
            for i in range(1, len(k) - d + 1):
                own = (k[0], *k[i : i + d])
                if 100 * v >= 100 * f[own]:
                    inner.add(own)
    out = []
    for lang in n:
        own = []
        for k, a in much.items():
            if k[0] == lang and k not in inner:
                score, cut = min((1000 * a * n[lang] // (f[k[: c + 1]] * f[(lang, *k[c + 1 :])]), c) for c in range(1, len(k) - 1))
                own.append((-score, -a, " ".join(k[1:]).encode(), f[k[: cut + 1]], f[(lang, *k[cut + 1 :])]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(own)[:top])]
    return sorted(out)


def test_phrases_by_force(spark):
    r = random.Random(3)
    voc = [f"w{i}" for i in range(12)] + ["A", "É", "a\x01", "a", "é-b", "\x00", "a b"]
    rows = []
    for i in range(150):
        words = [r.choice(voc) + r.choice([" ", " ", " ", "\t", ". ", "! ", "\n", " \x0c"]) for _ in range(r.randint(0, 60))]
        rows.append((r.choice(["en", "en", "en", "de", None, "und"]), "".join(words)))
    rows += [("en", "w1 w2 w3 w4 w5 w6 w7")] * 40 + [("fr", "hot hot hot hot hot hot hot")] * 30 + [("en", None), ("en", ""), (None, "one"), ("de", "x " * 5000)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5).withColumns({c: F.lit("clash") for c in ("n", "path", "kind", "rank", "range")})
    for deepest, places, top in ((5, 1 << 23, 2000), (5, 500, 7), (2, 2000, 2000)):
        got = phrases.collocations(df, deepest=deepest, least=6, top=top, places=places).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
        assert sorted(map(tuple, got.collect())) == phrases_by_force(rows, deepest, 6, top)
    assert phrases.collocations(df.limit(0)).count() == 0


def test_merge_of_runs():
    r = random.Random(1)
    total, runs = Counter(), []
    for _ in range(5):
        own = Counter(("en", *r.choices("abcdefgh", k=2)) for _ in range(30_000))
        own.update((r.choice(["de", "en"]), f"x{r.randrange(20_000)}") for _ in range(20_000))
        total.update(own)
        keys = sorted(own)
        table = pa.Table.from_arrays([pa.array([k[0].encode() for k in keys]), pa.array([" ".join(k[1:]).encode() for k in keys]), pa.array([own[k] for k in keys])], schema=phrases.RUN)
        runs.append(phrases.serialised(table))
    found = Counter()
    for t in phrases.merged(runs, 3):
        for lang, path, n in zip(*(c.to_pylist() for c in t.columns)):
            assert (lang.decode(), *path.decode().split()) not in found
            found[(lang.decode(), *path.decode().split())] = n
    assert found == {k: v for k, v in total.items() if v >= 3}


# chat text

PARTS = st.lists(st.sampled_from(["<", "[", "\\", "s>", "/s>", "INST]", "/INST]", "<SYS>>", "</SYS>>", "ROLE]", "/ROLE]", "<s>", "[INST]", "a", "é", " ", "\n"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "[/ROLE]", None]), st.one_of(st.none(), PARTS)), min_size=1, max_size=6))
def test_assembled_turns_read_back(rows):
    buffer, begin, content, stop = chat.assemble(pa.array([x for x, _ in rows], pa.string()), pa.array([x for _, x in rows], pa.string()))
    data = buffer.to_pybytes()
    assert chat.turns(data) == [((role or "").encode(), (text or "").encode()) for role, text in rows]
    for (_, text), a, b in zip(rows, content, stop):
        own = data[a:b]
        assert chat.unescape(own) == (text or "").encode() and not re.search(rb"<s>|</s>|\[/?INST\]|<</?SYS>>|\[/?ROLE\]", own)
        assert own == chat.escape((text or "").encode())
    assert int(begin[-1]) == len(data)


def test_chat_by_force(spark):
    r = random.Random(5)
    texts = ["", None, "</s>[INST] ok [/INST]", "<\\s>", "é" * 50, "plain text\nof lines"]
    rows = [(c, t, r.choice(["user", "assistant", "assistant", "system", "tool", None]), r.choice(texts)) for c in range(60) for t in range(r.randint(1, 6))]
    rows += [(1000, t, "user" if t % 2 else "assistant", f"turn {t} <s>") for t in range(12_000)]  # a third and more of all rows
    rows += [(None, 0, "user", "no id"), (None, None, "assistant", "no id"), (7_000, None, "assistant", "b"), (7_000, None, "assistant", "a")] + [(7_001, 3, "user", "same")] * 300
    rows += [(7_002, 0, "assistant", "x" * 300_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6).withColumns({c: F.lit("clash") for c in ("run", "chunk", "edge", "loss", "n")}).cache()

    low = (float("-inf"),)
    conv = {}
    for c, t, role, text in sorted(rows, key=lambda x: ((x[0] is not None, x[0] or 0), low if x[1] is None else (x[1],), (x[2] is not None, (x[2] or "").encode()), (x[3] is not None, (x[3] or "").encode()))):
        conv.setdefault(c, []).append((role or "", text or ""))
    expected = {}
    for c, own in conv.items():
        loss = "".join(t for x, t in own if x == "assistant")
        head = {"system": 22, "user": 20, "assistant": 7}
        chars = sum(head.get(x, 20 + len(x)) + len(chat.escape(t.encode()).decode()) for x, t in own)
        expected[c] = (len(own), hashlib.sha256("".join(f"{x}\n{t}\n" for x, t in own).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars)
    for most in (chat.SLICE_BYTES, 2_000):
        formatted = chat.format_chat(df, most=most).cache()
        assert formatted.filter("not edge").count() > 30
        if most == 2_000:
            assert formatted.filter("conv_id = 1000").count() > 100
        got = {x[0]: tuple(x[1:]) for x in chat.read_back(formatted).collect()}
        assert got == expected
    assert chat.read_back(chat.format_chat(df.limit(0))).count() == 0


# manifests


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree_by_force(leaves):
    """Top and, for each leaf, its way (left, right by level)."""
    ways, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for i, way in enumerate(ways):
            run = at[i] // 3 * 3
            way.append(("".join(level[run : at[i]]), "".join(level[at[i] + 1 : run + 3])))
            at[i] //= 3
        level = [h(*level[i : i + 3]) for i in range(0, len(level), 3)]
    return level[0], ways


def test_manifest_by_force(spark):
    r = random.Random(6)
    rows = [(i, r.choice(["hot", "hot", "hot", "b", "é", None]), r.choice(["en", None]), r.choice([None, 5]), r.choice([None, "", "a\nb", "é\n\n", "plain", "x" * 9_000])) for i in range(300)]
    rows += [(1_000 + i, f"s{i}", "en", 1, "a\nb") for i in range(30)] + [(2_000, "hot", "en", 1, "same\n")] * 50 + [(None, "hot", None, None, f"t{i}") for i in range(20)] + [(None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    own = df.select("source", "doc_id", merkle.leaf(*fields, F.col("text")).alias("leaf"), merkle.leaf(*fields, F.translate("text", "\n", "")).alias("other")).withColumns({c: F.lit("clash") for c in ("g", "at", "part", "way", "tip", "root", "block")})

    one = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda x: h(*map(one, x))
    groups = {}
    for x in rows:
        groups.setdefault(x[1], []).append(((x[0] is not None, x[0] or 0, leaf(x)), leaf((*x[:4], x[4] and x[4].replace("\n", "")))))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    tops, trees = [], {}
    for g in names:
        groups[g].sort()
        trees[g] = tree_by_force([k[2] for k, _ in groups[g]])
        tops.append(trees[g][0])
    root, above = tree_by_force(tops)
    expected = []
    for g, up in zip(names, above):
        for ((has, doc, first), other), way in zip(groups[g], trees[g][1]):
            node = other
            for a, b in [*way, *up]:
                node = h(a, node, b)
            expected.append((doc if has else None, first, trees[g][0], root, h(*[x for pair in [*way, *up] for x in pair]), node, node == root))
    for height in (1, 2, merkle.HEIGHT):
        got = [tuple(x) for x in merkle.manifest(own, height=height).collect()]
        assert sorted(got, key=str) == sorted(expected, key=str)
    full = merkle.manifest(own, full=True, height=2).filter("doc_id = 5").first()
    node = full.leaf
    for x in full.siblings:
        node = h(x.left, node, x.right)
    assert node == full.root == root
    assert merkle.manifest(own.limit(0)).count() == 0


def test_new_operators_on_awkward_documents(spark, tmp_path):
    df, rows = awkward(spark, [(5, None), (5, "another text of the same id"), (None, None)])
    df = df.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s"), "n_chars": F.length("text")})
    assert phrases.collocations(df, least=2).filter("a < 2").count() == 0
    own = df.select("source", "doc_id", merkle.leaf(F.col("doc_id"), F.col("text")).alias("leaf")).withColumn("other", F.col("leaf"))
    out = merkle.manifest(own)
    assert out.count() == len(rows) and out.filter("not verified").count() == 0
