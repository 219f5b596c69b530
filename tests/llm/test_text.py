"""Language ID, licences, secrets, mixing, chats and media."""

import base64
import gzip
import io
import struct
import wave
import zipfile
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.llm import chat, language_id, license_scan, media, mixing, secret_scan
from textloom.llm.common import buffers

SF = "/root/testdata/sf0.01"


def sql(query, **views):
    con = duckdb.connect()
    for name, path in views.items():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con.execute(query).fetchall()


# --- language ---------------------------------------------------------------------------------------------------------


def test_languages_of_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit(docs.where("doc_id % 2 = 0"))
    got = language_id.identify(docs.where("doc_id % 2 = 1"), model=model).join(docs.select("doc_id", "lang", "n_chars"), "doc_id").toPandas()
    clean = got[got.n_chars >= 200]
    assert (clean.predicted == clean.lang).mean() > 0.99 and (clean.predicted != "und").mean() > 0.995
    foreign = spark.createDataFrame([(1, "xqzw vbnmk qqrtz plkj wxyz zzxq kkjh vvkq"), (2, "привет как дела это русский текст без конца"), (3, "4711 0815 !!! ### 17"), (4, "日本語のテキストです。これは長い文章です")], "doc_id bigint, text string")
    assert {r.predicted for r in language_id.identify(foreign, model=model).collect()} == {"und"}


def test_languages_of_odd_rows(table, odd_rows, spark):
    rows = language_id.identify(table(odd_rows)).collect()
    assert len(rows) == len(odd_rows)
    assert [r.predicted for r in rows if r.doc_id in (3, 4, 5)] == ["und"] * 3 and all(r.similarity == 0 for r in rows if r.doc_id in (3, 4, 5))
    kept = language_id.keep_identified(table(odd_rows))
    assert kept.schema == table([]).schema and kept.where("doc_id IN (3, 4, 5)").count() == 0 and kept.where("doc_id = 2").count() == 2
    assert language_id.identify(table([])).count() == 0
    unlabelled = language_id.identify(spark.createDataFrame([(1, "some text", None)], "doc_id bigint, text string, lang string"))
    assert unlabelled.first().predicted == "und"


def test_document_frequencies_cover_all_rows(spark):
    df, n = language_id.document_frequencies(spark.createDataFrame([("ab",), ("ab ab",), ("cd",), (None,), ("",)], "t string"), "t")
    assert n == 5 and df.max() == 2


def test_training_sample_is_bounded(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sample = language_id.labelled_sample(docs, "text", "lang", 20)
    assert sample.groupby("lang").size().to_dict() == {"de": 20, "en": 20, "es": 20, "fr": 20}


def test_no_language_is_lost(spark):
    """A language of few texts with many copies is learnt from as others are."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    texts = F.array(*map(F.lit, ("zzq vvk qqj xxw jjq kkz wwq", "qqz jjx kkv wwz xxq vvj zzk", "xxz qqv wwk jjz vvq zzj kkx")))
    copies = spark.range(100_000).select((F.col("id") + 10**6).alias("doc_id"), F.element_at(texts, (F.col("id") % 3 + 1).cast("int")).alias("text"), F.lit("xx").alias("lang"))
    sample = language_id.labelled_sample(docs.unionByName(copies), "text", "lang")
    sizes = sample.groupby("lang").size().to_dict()
    wanted = {r.lang: min(r.n, language_id.TRAIN_ROWS) for r in docs.groupBy("lang").agg(F.countDistinct("text").alias("n")).collect()}
    assert sizes == wanted | {"xx": 3}


def naive_grams(text):
    """Hashed 2-grams and 3-grams, counted one at a time."""
    flat = []
    for byte in text.encode():
        if 65 <= byte <= 90:
            byte += 32
        flat.append(byte)
    for i in range(1, len(flat)):
        if flat[i - 1] == 0xC3 and 0x80 <= flat[i] <= 0x9E and flat[i] != 0x97:
            flat[i] += 32
    kept = []
    for byte in flat:
        byte = byte if 97 <= byte <= 122 or byte == 39 or byte >= 128 else 32
        if byte != 32 or not kept or kept[-1] != 32:
            kept.append(byte)
    out = {}
    for k in (2, 3):
        for i in range(len(kept) - k + 1):
            code = (k << 28) & 0xFFFFFFFF
            code = (int.from_bytes(bytes(kept[i : i + k]), "big") + code) & 0xFFFFFFFF
            code = code * 2654435761 & 0xFFFFFFFF
            code ^= code >> 15
            code = code * 2246822519 & 0xFFFFFFFF
            out[code >> 20] = out.get(code >> 20, 0) + 1
    return out


def naive_language(model, text):
    """Cosine with each centroid, term by term; the least accepted one by the number of n-grams."""
    grams = naive_grams(text)
    vector = {k: np.log1p(n) * float(model.idf[k]) for k, n in grams.items()}
    norm = np.sqrt(sum(v * v for v in vector.values())) or 1.0
    sims = [sum(v * float(c[k]) for k, v in vector.items()) / norm for c in model.centres]
    best = int(np.argmax(sims))
    bucket = sum(sum(grams.values()) >= n for n in language_id.LENGTHS)
    return (model.languages[best] if grams and sims[best] >= model.radius[bucket] else "und"), sims[best]


def test_languages_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_id.fit(docs)
    got = {r.doc_id: r for r in language_id.identify(docs, model=model).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        name, sim = naive_language(model, r.text)
        assert got[r.doc_id].predicted == name and abs(got[r.doc_id].similarity - sim) < 0.002


# --- licences ---------------------------------------------------------------------------------------------------------


def scan(spark, rows):
    return sorted(tuple(r) for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())


def naive_licenses(text):
    """Every template at every place: the share of its distinct shingles within the passage there."""
    import re

    said = [w.lower() for w in re.findall(r"(?:[0-9A-Za-z]|[^\x00-\x7f])+", text)]
    runs = list(zip(said, said[1:]))
    found = {}
    for name, template in license_scan.TEMPLATES:
        own = [w.lower() for w in re.findall(r"[0-9A-Za-z]+", template)]
        wanted = set(zip(own, own[1:]))
        n = len(own) - 1
        room = max(2, n // 4)
        if len(wanted & set(runs)) < license_scan.CONTAINED * len(wanted):
            continue
        best = max(len(wanted & set(runs[max(0, b - room) : b + n + room])) for b in range(-n, len(runs))) / len(wanted)
        if best >= license_scan.CONTAINED:
            found[name] = max(found.get(name, 0), best)
    return found


def test_licenses_match_brute_force(spark):
    """Each template's every distinct shingle is looked for at every place of every text."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rng = np.random.default_rng(4)
    made = []
    for i, (name, text) in enumerate(license_scan.TEMPLATES):
        words = text.split()
        edited = " ".join(w if rng.random() > 0.02 else "changed" for w in words)
        made += [(10**6 + 3 * i, f"some words before {text} and after"), (10**6 + 3 * i + 1, "x " * 40 + edited), (10**6 + 3 * i + 2, " ".join(words[: len(words) // 2]))]
    got = {}
    for r in license_scan.scan_licenses(docs.union(spark.createDataFrame(made, "doc_id bigint, text string"))).collect():
        got.setdefault(r.doc_id, {})[r.license] = r.containment
    wanted = {i: w for i, t in [*((r.doc_id, r.text) for r in docs.collect()), *made] if (w := naive_licenses(t))}
    # of licences that match the same words the best one counts: others of the brute force's are left out
    assert got.keys() == wanted.keys() and len(got) > 80
    for i, held in got.items():
        assert held.keys() <= wanted[i].keys() and all(abs(v - wanted[i][k]) < 0.01 for k, v in held.items()), (i, held, wanted[i])
        if i < 10**6:
            assert held.keys() == wanted[i].keys()
        else:
            assert max(wanted[i].values()) - max(held.values()) < 0.01


def test_licenses_in_passages(spark):
    filler = " ".join(f"word{i}" for i in range(300))
    mit = next(t for n, t in license_scan.TEMPLATES if n == "MIT" and len(t) > 200)
    gpl = [t for n, t in license_scan.TEMPLATES if n == "GPL-2.0"][0]
    edited = mit.replace("free of charge", "gratis").replace("limitation", "limits")
    rows = [(1, f"{filler} {mit} {filler}"), (2, f"{filler}\n// {edited.upper()}"), (3, filler), (4, gpl), (5, mit[: len(mit) // 2]), (6, "Licensed under CC BY 4.0. " + filler + " Released\n * under the MIT License"), (7, "")]
    got = scan(spark, rows)
    assert [(d, n) for d, n, _ in got] == [(1, "MIT"), (2, "MIT"), (4, "GPL-2.0"), (6, "CC-BY-4.0"), (6, "MIT")]
    assert got[0][2] == 1.0 and license_scan.CONTAINED <= got[1][2] < 1


def test_adjacent_licenses():
    """Every pair of templates, with up to 8 words between them."""
    library, texts, wanted = license_scan.Library(), [], []
    for a, one in license_scan.TEMPLATES:
        for b, two in license_scan.TEMPLATES:
            for n in (0, 3, 8):
                texts.append(" ".join([one, *(f"word{i}" for i in range(n)), two]))
                wanted.append(sorted({a, b}))
    off, data = buffers(pa.array(texts))
    got = [[] for _ in texts]
    for row, name, _ in library.scan(data, off):
        got[row].append(name)
    assert [(t, g, w) for t, g, w in zip(texts, got, wanted) if g != w] == []


def test_licenses_of_odd_rows(spark, table, odd_rows):
    df = table([*odd_rows, (None, "Released under the MIT License.", None, None, None), (11, "Released under the MIT License.", None, None, None), (11, "Released under the MIT License.", None, None, None)])
    assert sorted((tuple(r) for r in license_scan.scan_licenses(df).collect()), key=str) == [(11, "MIT", 1.0), (11, "MIT", 1.0), (None, "MIT", 1.0)]
    assert license_scan.scan_licenses(table([])).count() == 0


def test_band_probability():
    for similarity, least in ((0.6, 0.99), (0.45, 0.9)):
        assert 1 - (1 - similarity**license_scan.ROWS) ** license_scan.BANDS > least


# --- secrets ----------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def network():
    return secret_scan.train()


def test_held_out_findings(network):
    _, measures = network
    assert measures["recall"] >= 0.97 and measures["precision"] >= 0.97
    assert measures["recall_bare"] >= 0.95 and measures["recall_named"] >= 0.97


def brute_candidates(text):
    """Every maximal run of token characters, by a scan of its own."""
    import re

    return {m.span() for m in re.finditer(r"[A-Za-z0-9+/_\-=.]{16,}", text) if re.search(r"\d", m[0]) and re.search(r"[A-Za-z]", m[0])}


def test_candidates():
    texts = ["", "x" * 20 + "1", "no digits in averylongwordofletters", 'token = "0123456789abcdef0123"; pwd: hunter2x', "abc1234567890123" + "z" * 500, "password=a"]
    off, data = buffers(pa.array(texts))
    a, b, kind = secret_scan.candidates(data, off)
    got = [(int(np.searchsorted(off, x, "right")) - 1, bytes(data[x:y]).decode()) for x, y in zip(a, b)]
    assert got == [(1, "x" * 20 + "1"), (3, "0123456789abcdef0123"), (3, "hunter2x"), (4, texts[4])]
    assert kind.tolist() == [secret_scan.BARE, secret_scan.NAMED, secret_scan.NAMED, secret_scan.BARE]


def test_long_candidates_are_scored_whole(spark, network):
    key = "AKIA" + "Q7ZK2M9XW4T8R3B6"
    url = "auth=basic&next=/" + "home/pages/" * 9 + f"&key={key}&page=1" + "/about/us" * 9
    off, data = buffers(pa.array([url, "see " + "p/" * 500 + "1"]))
    a, b, _ = secret_scan.candidates(data, off)
    assert any(key in bytes(data[x:y]).decode() and y - x < secret_scan.INSIDE for x, y in zip(a, b))
    x, y, of = secret_scan.pieces(a, b)
    for k, (lo, hi) in enumerate(zip(a, b)):
        assert set().union(*(range(p, q) for p, q in zip(x[of == k], y[of == k]))) == set(range(lo, hi))
    secret = 'api_key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"'
    df = spark.createDataFrame([(1, "/home/pages" * 9 + "1"), (2, url), (3, secret)], "doc_id int, text string")
    got = secret_scan.scan_secrets(df, network=network[0]).collect()
    assert {r.doc_id for r in got if r.is_secret} == {2, 3} and (2, 5) in {(r.doc_id, r.begin) for r in got if r.is_secret}


def test_every_run_is_a_candidate(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    off, data = buffers(pa.array(texts))
    a, b, _ = secret_scan.candidates(data, off)
    row = np.searchsorted(off, a, "right") - 1
    got = {(int(r), bytes(data[x:y]).decode()) for r, x, y in zip(row, a, b)}
    wanted = {(i, t[s:e]) for i, t in enumerate(texts) for s, e in brute_candidates(t)}
    assert wanted == got


def naive_values(text):
    """Values after telling names, sign by sign; of values within each other the outermost."""
    import re

    out, names = [], "|".join(n.decode() for n in secret_scan.NAMES)
    for m in re.finditer("[=:]", text):
        if re.search(rf"(?i:{names})[\t \"\']{{0,4}}\Z", text[max(0, m.start() - 20) : m.start()]):
            value = re.match(r"[\t \"\']{0,4}([^\x00-\x20\"\',;]{6,})", text[m.end() :])
            if value and not (out and out[-1][1] == m.end() + value.end(1)):
                out.append((m.end() + value.start(1), m.end() + value.end(1)))
    return out


def test_named_values_match_brute_force():
    rng = np.random.default_rng(5)
    bits = ["password", "Token", "api_key", "x", "=", ":", " ", '"', "'", ",", ";", "\n", "a1b2c3d4", "hunter22", "token=", "secret: ", "abc", "==", "        "]
    texts = ["".join(rng.choice(bits, rng.integers(1, 40))) for _ in range(400)]
    off, data = buffers(pa.array(texts))
    a, b, kind = secret_scan.candidates(data, off)
    got = [[] for _ in texts]
    for x, y, k in zip(a, b, kind):
        if k == secret_scan.NAMED:
            row = int(np.searchsorted(off, x, "right")) - 1
            got[row].append((int(x - off[row]), int(y - off[row])))
    assert got == [naive_values(t) for t in texts] and sum(map(len, got)) > 300


def naive_score(net, codes):
    """The network's layers, one number at a time."""
    x = [net.table[c] for c in codes]
    zero = np.zeros(secret_scan.EMBED)
    act = []
    for at in range(len(x)):
        seen = [x[at + k] if 0 <= at + k < len(x) else zero for k in range(-(secret_scan.KERNEL // 2), secret_scan.KERNEL // 2 + 1)]
        act.append([sum(float(seen[k][e]) * float(net.kernel[k * secret_scan.EMBED + e, f]) for k in range(secret_scan.KERNEL) for e in range(secret_scan.EMBED)) + float(net.bias[f]) for f in range(secret_scan.FILTERS)])
    hidden = [max(0.0, max(a[f] for a in act[part])) for part in net.PARTS for f in range(secret_scan.FILTERS)]
    logit = sum(h * float(w) for h, w in zip(hidden, net.out)) + net.shift
    return 1 / (1 + np.exp(-(net.scale[0] * logit + net.scale[1])))


def test_scores_match_brute_force(network):
    texts, spans, _, _ = secret_scan.labelled_findings(12, 99)
    codes = secret_scan._codes(texts, spans)
    assert np.allclose(network[0].scores(codes), [naive_score(network[0], c) for c in codes], atol=1e-4)


@pytest.mark.parametrize("pattern", ["token=", "a=b:", "password: '", "=", "token: ", "k" * 63 + "1="])
def test_secrets_in_a_megabyte_of_one_pattern(pattern, network):
    import time

    off, data = buffers(pa.array([pattern * (10**6 // len(pattern))]))
    began = time.process_time()
    a, b, _ = secret_scan.candidates(data, off)
    secret_scan.scored(network[0], data, off, a[:2000], b[:2000])
    assert time.process_time() - began < 20


def test_secrets_in_documents(spark, network):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = secret_scan.scan_secrets(docs, network=network[0]).join(docs.select("doc_id", "text"), "doc_id").collect()
    told = {(r.doc_id, r.begin): r.is_secret for r in rows}
    assert all(told[r.doc_id, r.begin] == ("oken" in r.text.encode()[: r.begin].decode("utf-8", "ignore")[-12:].lower()[-12:] or "oken" in r.text.encode()[max(0, r.begin - 12) : r.begin].decode("latin-1").lower()) for r in rows)


def test_secrets_of_odd_rows(table, odd_rows, network):
    secret = 'api_key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"'
    df = table([*odd_rows, (None, secret, None, None, None), (20, "é " + secret, None, None, None), (20, "é " + secret, None, None, None)])
    got = [tuple(r) for r in secret_scan.scan_secrets(df, network=network[0]).collect() if r.is_secret]
    assert sorted([g[:3] for g in got], key=str) == sorted([(None, 11, 51), (20, 14, 54), (20, 14, 54)], key=str)
    assert secret_scan.scan_secrets(table([]), network=network[0]).count() == 0


# --- mixing -----------------------------------------------------------------------------------------------------------


def test_mixing_matches_sql(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = [tuple(r) for r in mixing.mix_sources(docs, copy_col="copy").collect()]
    assert sorted(got) == sorted(sql(mixing.MIX_SQL, documents=f"{SF}/documents.parquet"))
    ids = [g[0] for g in got]
    assert ids != sorted(ids) and abs(np.corrcoef(ids, np.arange(len(ids)))[0, 1]) < 0.2


def test_mixing_reaches_its_weights(spark):
    rows = [(i, f"text {i} " + "x" * (i % 50), "big" if i % 10 else "small") for i in range(20000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    out = mixing.mix_sources(df, {"big": 1.0, "small": 3.0, "none": 2.0}).groupBy("source").agg(F.sum(F.length("text")).alias("n")).collect()
    n = {r.source: r.n for r in out}
    assert abs(n["small"] / (n["small"] + n["big"]) - 0.75) < 0.02
    assert mixing.mix_sources(df, {"small": 1.0}).where("source = 'big'").count() == 0
    chars = lambda d: d.agg(F.sum(F.length("text"))).first()[0]
    assert abs(chars(mixing.mix_sources(df, epochs=2.0)) / chars(df) / 2 - 1) < 0.05


def test_poisson_inversion():
    for rate in (0.01, 0.7, 3.0, 40.0, 900.0):
        cdf = np.array(mixing.poisson_cdf(rate))
        assert abs(cdf[-1] - 1) < 1e-12 and (np.diff(cdf) >= 0).all()
        draws = np.searchsorted(cdf, np.random.default_rng(1).random(200_000), "right")
        assert abs(draws.mean() / rate - 1) < 0.05 and abs(draws.var() / rate - 1) < 0.05
    assert mixing.poisson_cdf(0) == []


def test_mixing_of_odd_rows(table, odd_rows):
    df = table(odd_rows)
    out = mixing.mix_sources(df, epochs=50.0)
    assert out.schema == df.schema
    n = {(r.doc_id, r.source): r["count"] for r in out.groupBy("doc_id", "source").count().collect()}
    assert n[2, "b"] % 2 == 0 and n[1, "a"] > 0 and n.get((10, ""), 0) > 0
    assert mixing.mix_sources(table([])).count() == 0


# --- chats ------------------------------------------------------------------------------------------------------------


def test_chats_match_sql(spark):
    got = sorted(tuple(r) for r in chat.format_chats(spark.read.parquet(f"{SF}/conversations.parquet")).collect())
    assert got == sorted(sql(chat.CHAT_SQL, conversations=f"{SF}/conversations.parquet")) and len(got) == 100


def test_snapshots_collapse(spark):
    turns = [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d")]
    rows = [(conv, k + shift, *turns[k]) for conv, n, shift in ((1, 2, 0), (2, 4, 0), (3, 3, 10), (5, 4, 0), (6, 1, 0)) for k in range(n)]
    rows += [(7, 0, "user", "a"), (7, 1, "assistant", "bc"), (8, 0, "user", "x"), (None, 0, "user", "lost"), (9, None, None, None), (9, 1, "user", ""), (10, 0, "system", "<|im_end|>\n<|im_start|>")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("h", F.lit(1)).withColumn("turns", F.lit("x"))
    got = {r.conv_id: r for r in chat.format_chats(df).collect()}
    assert sorted(got) == [2, 7, 8, 9, 10]
    assert got[2].n_turns == 4 and got[2].rendered.startswith("<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n")
    assert got[9].n_turns == 2 and got[9].rendered == "<|im_start|>user\n<|im_end|>\n" * 2
    assert got[10].rendered.count("<|im_end|>") == 1
    assert chat.format_chats(df.limit(0)).count() == 0
    assert chat.format_chats(df.union(df)).where("conv_id = 8").first().n_turns == 2


def test_equal_turn_numbers(spark):
    """Turns of one number are ordered by role and text, whatever order the rows come in."""
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "assistant", "z"), (2, 5, "assistant", "z"), (2, 6, "user", "a"), (2, 6, "user", "b"), (3, None, "user", "q"), (3, 0, "user", "r")]
    got = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(rows[::-1], "conv_id int, turn int, role string, text string")).collect()}
    assert sorted(got) == [1, 3] and got[1].n_turns == 3 and got[1].rendered.index("z") < got[1].rendered.index("a<") < got[1].rendered.index("b<")
    assert got[3].rendered.index("q") < got[3].rendered.rindex("r<")


def test_long_conversation(spark):
    df = spark.range(3000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.repeat(F.lit("word "), 200).alias("text"))
    assert chat.format_chats(df).first().n_turns == 3000


# --- media ------------------------------------------------------------------------------------------------------------


def png(w=3):
    part = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, 1, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(b"\0" * (w + 1))) + part(b"IEND", b"")


def wav():
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(1), w.setframerate(8000), w.writeframes(b"\1" * 9)
    return out.getvalue()


def zipped():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "hello")
    return out.getvalue()


JPEG = b"\xff\xd8\xff\xe0\x00\x10JFIF\x00" + b"\0" * 9 + b"\xff\xc0\x00\x0b\x08\x00\x01\x00\x01\x01\x01\x11\x00" + b"\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00" + b"\x12\xff\x00\x34" + b"\xff\xd9"
GIF = b"GIF89a\x01\x00\x01\x00\x80\x00\x00" + b"\0" * 6 + b"!\xf9\x04\0\0\0\0\0" + b",\0\0\0\0\x01\0\x01\0\0\x02\x02D\x01\0;"
BMP = b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0\0\0\0"
PDF = b"%PDF-1.4\n1 0 obj<<>>endobj\nstartxref\n9\n%%EOF"
MP4 = struct.pack(">I", 16) + b"ftypisom\0\0\0\0" + struct.pack(">I", 12) + b"mdat1234" + struct.pack(">I", 8) + b"moov"
OGG = b"OggS\0\x06" + b"\0" * 20 + b"\x01\x03abc"
WEBP = b"RIFF" + struct.pack("<I", 4 + 8 + 2) + b"WEBPVP8 " + struct.pack("<I", 2) + b"xx"
FLAC = b"fLaC\x80\0\0\x22" + b"\0" * 34 + b"\xff\xf8data"
FORMATS = {"image/png": png(), "image/jpeg": JPEG, "image/gif": GIF, "image/bmp": BMP, "application/pdf": PDF, "video/mp4": MP4, "audio/ogg": OGG, "image/webp": WEBP, "audio/wav": wav(), "application/zip": zipped(), "application/gzip": gzip.compress(b"hello" * 9)}


@pytest.mark.parametrize("kind", [*FORMATS, "audio/flac"])
def test_formats(kind):
    data = FORMATS.get(kind, FLAC)
    assert media.sniff(data) == (kind, [])
    assert media.sniff(data[: len(data) * 2 // 3])[0] != kind
    if kind in FORMATS:
        assert media.sniff(b"junk\0" + data + b"tail")[1] == [(5, len(data), kind, "raw")]


def test_many_in_one():
    blob, wanted = b"\0start", []
    for kind, data in FORMATS.items():
        wanted.append((len(blob), len(data), kind, "raw"))
        blob += data + b"--"
    assert media.sniff(blob) == ("application/octet-stream", wanted)
    broken = bytearray(png())
    broken[20] ^= 1
    assert media.sniff(bytes(broken))[0] == "application/octet-stream"


def test_data_addresses():
    page = b'<!DOCTYPE html><html><img src="data:image/gif;base64,' + base64.b64encode(png()) + b'"> BM PK <a href="data:text/plain;base64,aGVsbG8=">'
    kind, inside = media.sniff(page)
    assert kind == "text/html" and inside == [(page.index(b"iVBOR"), len(png()), "image/png", "base64")]


def test_html_in_every_spelling(spark):
    far = b" " * 5000 + b"<!-- " + b"x" * 5000 + b" --><HTML lang=en>"
    pages = [
        b'<!DOCTYPE HTML PUBLIC "-//W3C//DTD HTML 4.01//EN" "http://www.w3.org/TR/html4/strict.dtd">\n<HTML>', b"<HTML><BODY>a", b"<!doctype html><title>a</title>b", b"\xef\xbb\xbf<!DOCTYPE html><html>", b"\r\n <html>",
        b"<!-- a > b --><!DOCTYPE html>", b'<?xml version="1.0"?>\n<!DocType\nHtml>\n<html xmlns="x">', b"<!DOCTYPE html>" + b" " * 5000 + b"<html>", far, "\ufeff<!DOCTYPE html><html>".encode("utf-16-le"), b"<!--><html>",
    ]
    assert [media.sniff(p)[0] for p in pages] == ["text/html"] * len(pages)
    others = [b"say <html>", b"<htmlx>", b"<!DOCTYPE htmlx>", b'<?xml version="1.0"?><svg><html></svg>', b"<!-- <html>", b"<?xml <html"]
    assert [media.sniff(p)[0] for p in others] == ["text/plain"] * len(others)
    # as before, objects inside a page are listed
    assert media.sniff(b"\n<HTML>" + png())[1] == [(7, len(png()), "image/png", "raw")]
    df = spark.createDataFrame([(1, pages[0]), (2, b"<p>a part</p>"), (3, png())], "id int, content binary")
    got = media.sniff_media(df, "id", "content", F.lit("text/html")).orderBy("id").collect()
    assert [(r.corrected, r.media_type) for r in got] == [(False, "text/html"), (False, "text/html"), (True, "image/png")]


def test_media_columns(spark):
    rows = [(1, png(), "IMAGE/jpeg "), (2, png(), None), (3, b"plain words", "image/png"), (4, None, "image/png"), (5, b"", "image/png"), (6, b"\0\1", "application/x-own"), (None, JPEG, "image/jpeg"), (7, b"plain", " "), (8, b"\0a" + GIF, "image/gif")]
    df = spark.createDataFrame(rows, "id int, content binary, declared string").withColumn("v", F.lit(1)).withColumn("detected", F.lit("x"))
    got = {r.id: r for r in media.sniff_media(df, "id", "content", F.col("declared")).collect()}
    assert (got[1].declared, got[1].corrected, got[1].media_type) == ("image/jpeg", True, "image/png")
    assert (got[2].corrected, got[2].media_type) == (False, "image/png") and (got[3].corrected, got[3].media_type) == (True, "text/plain")
    assert got[4].detected is None and got[4].media_type == "image/png" and got[4].embedded is None
    assert got[5].detected == "" and not got[5].corrected and got[6].media_type == "application/x-own" and got[None].media_type == "image/jpeg"
    assert got[7].media_type == "text/plain" and got[8].media_type == "application/octet-stream" and got[8].embedded[0].type == "image/gif"
    carved = {r.id: r for r in media.carve(df, "id", "content").collect()}
    assert list(carved) == [8] and bytes(carved[8].data) == GIF and carved[8].offset == 2
    coded = base64.b64encode(wav())
    pages = [b'<html ><img src="data:' + head + b";base64," + text + b'">' for head in (b"", b"audio/wav", b";charset=x") for text in (coded, coded.rstrip(b"="), coded.replace(b"=", b"%3D"))]
    only = media.carve(spark.createDataFrame(list(enumerate(pages)), "id int, content binary"), "id", "content").collect()
    assert len(only) == 9 and all(bytes(r.data) == wav() for r in only)
    assert media.sniff_media(df.limit(0), "id", "content", F.col("declared")).count() == 0


def naive_objects(data):
    """Each signature is tried at each place, with nothing remembered."""
    out, reached = [], 0
    if size := media._html(data):
        out.append((0, size, media.HTML))
    for at in range(len(data)):
        for magic, shift, kind, check in media.SIGNATURES:
            if at >= reached and data.startswith(magic, at + shift) and not (at and kind in media.WHOLE_ONLY) and (size := check(data, at, {})):
                out.append((at, size, kind))
                reached = at + size
    return out


def test_media_match_brute_force(spark):
    rng = np.random.default_rng(6)
    whole = [*FORMATS.values(), FLAC, OGG[:20], b"\0\0\0\x08ftyp", b"PK\x03\x04", b"<html>", JPEG[:9], b"BM", PDF[:-5], b"text ", b"\0\1\2"]
    blobs = [b"".join(whole[k] for k in rng.integers(0, len(whole), rng.integers(1, 12))) for _ in range(150)]
    assert [media.objects(b) for b in blobs] == [naive_objects(b) for b in blobs]
    pages = [r.html.encode() for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    assert [media.objects(p) for p in pages] == [naive_objects(p) for p in pages]


ONE_PATTERN = [
    OGG[:4] + b"\0\0" + b"\0" * 20 + b"\x01\x03abc", b"\0\0\0\x08ftyp", b"PK\x03\x04", b"PK\x03\x04PK\x05\x06" + b"\1" * 18, b"GIF89a", b"\x1f\x8b\x08\0", b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff",
    b"RIFF\x10\0\0\0WAVE", b"%PDF-1.4 startxref 1 ", b"BM", b"<!--", b"<?", b"data:;base64,", b"data:a/a;", b"fLaC",
]


@pytest.mark.parametrize("pattern", ONE_PATTERN)
def test_media_of_a_megabyte_of_one_pattern(pattern):
    import time

    began = time.process_time()
    media.sniff(pattern * (10**6 // len(pattern)))
    assert time.process_time() - began < 20


def test_media_of_odd_rows(spark):
    page = b"<html>" + png()
    rows = [(None, page, "x"), (None, None, None), (1, page, "x"), (1, page, "x"), (2, b"", "y")]
    df = spark.createDataFrame(rows, "id int, content binary, declared string").withColumns({n: F.lit(1) for n in ("data", "type", "offset", "embedded", "media_type")})
    got = media.sniff_media(df, "id", "content", F.col("declared"))
    assert got.columns == ["id", "declared", "detected", "corrected", "media_type", "embedded"] and got.count() == 5 and got.where("size(embedded) = 1").count() == 3
    carved = media.carve(df, "id", "content")
    assert carved.columns == ["id", "offset", "type", "data"] and sorted((r.id or 0, r.offset, bytes(r.data)) for r in carved.collect()) == [(0, 6, png()), (1, 6, png()), (1, 6, png())]
    assert media.carve(df.limit(0), "id", "content").count() == 0


def test_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = media.sniff_media(pages, "page_id", "html", F.coalesce(media.declared_by_address(F.col("url")), F.lit("text/html")))
    assert got.where("detected = 'text/html' AND NOT corrected AND size(embedded) = 0").count() == pages.count()


def test_big_content():
    blob = b"\0" + b"BMfLaCGIF89aPK\x03\x04" * 30_000 + png()
    assert media.sniff(blob)[1] == [(len(blob) - len(png()), len(png()), "image/png", "raw")]
