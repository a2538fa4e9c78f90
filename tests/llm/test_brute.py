"""Operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.llm import _hashing, _shared, _tokens, ann, decontamination, language_id, near_dups, packing, quality, queries, secret_scan, substring_dedup, training_order

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return dict(sorted((r[0], r[1] or "") for r in docs.collect()))


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def shingle_sets(texts, k):
    out = {}
    for i, t in texts.items():
        w = WORD.findall(lower(t))
        out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    return out


def brute_components(sets, percent=80):
    inverted, common, parent = defaultdict(list), Counter(), {i: i for i in sets}
    for i, s in sets.items():
        for g in s:
            inverted[g].append(i)
    for of in inverted.values():
        for a in range(len(of)):
            for b in range(a):
                common[of[b], of[a]] += 1

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for (a, b), c in common.items():
        if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_near_dups(spark, docs, texts):
    sets = shingle_sets(texts, 4)
    wanted = brute_components(sets)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dups.link(spark, docs, 4).collect()}
    assert got == {i: (len(sets[i]), c, c == i) for i, c in wanted.items()}


def test_near_dups_of_a_large_group(spark):
    """Copies with few to many edits of three bases, so that lists are shared and centres don't reach every copy."""
    rng = np.random.default_rng(5)
    texts = {}
    for b in range(3):
        base = [f"b{b}w{rng.integers(500)}" for _ in range(150)]
        for i in range(90):
            w = list(base)
            for p in rng.integers(0, 150, rng.integers(0, 14)):
                w[p] = f"e{rng.integers(6) if i % 3 else rng.integers(10**6)}"
            texts[1000 * b + i] = " ".join(w)
    sets = shingle_sets(texts, 4)
    got = {r["doc_id"]: r["component_id"] for r in near_dups.link(spark, spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 4).collect()}
    assert got == brute_components(sets)


def brute_dedup(texts):
    seen, out = set(), {}
    for i, t in sorted(texts.items()):
        w = WORD.findall(t)
        gone = [False] * len(w)
        for j in range(len(w) - 19):
            g = tuple(w[j : j + 20])
            if g in seen:
                gone[j : j + 20] = [True] * 20
            seen.add(g)
        out[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, y in zip(w, gone, strict=True) if not y).encode()).hexdigest())
    return out


def test_substring_dedup(spark, docs, texts):
    assert {r[0]: tuple(r)[1:] for r in substring_dedup.dedup_digest(spark, docs).collect()} == brute_dedup(texts)


def test_substring_dedup_repetitive(spark):
    rng = np.random.default_rng(3)
    texts = {i: " ".join(rng.choice(["a", "b"], 120, p=[0.9, 0.1])) for i in range(12)} | {20: "a " * 90, 21: "a b " * 60}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r[0]: tuple(r)[1:] for r in substring_dedup.dedup_digest(spark, df).collect()} == brute_dedup(texts)


@given(st.lists(st.text(alphabet="ab \t\né\x1c\x85", max_size=40), max_size=6), st.integers(1, 5))
@settings(max_examples=60, deadline=None)
def test_hashes(texts, k):
    data = [t.encode() for t in texts]
    words = [re.findall(rb"[^\x20\x09-\x0d]+", t) for t in data]
    h, bounds = _hashing.word_hashes(data, lower=False)
    assert np.diff(bounds).tolist() == [len(w) for w in words]
    names = {}
    for x, w in zip(h.tolist(), [w for of in words for w in of], strict=True):
        assert names.setdefault(w, x) == x
    assert len(set(names.values())) == len(names)
    win, first = _hashing.windows(h, bounds, k)
    assert np.diff(first).tolist() == [max(0, len(w) - k + 1) for w in words]
    names = {}
    for x, w in zip(win.tolist(), [tuple(w[i : i + k]) for w in words for i in range(len(w) - k + 1)], strict=True):
        assert names.setdefault(w, x) == x
    assert len(set(names.values())) == len(names)


def test_hashes_of_long_texts(monkeypatch):
    text = ("word " * 40 + "x" * 300 + " tail ") * 20
    whole = _hashing.word_hashes([text.encode()], True)
    monkeypatch.setattr(_hashing, "PIECE", 64)
    cut = _hashing.word_hashes([text.encode()], True)
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()


def test_tokens(texts):
    from tokenizers import Tokenizer

    path = _tokens.default_vocabulary()
    ours, plain, theirs = _tokens.encoder(path), _tokens.encoder(path, special=False), Tokenizer.from_file(path)
    some = [*list(texts.values())[:60], "", " ", "  a  b\x85 c\x1c", "<|endoftext|>", "hello <|endoftext|> world<|endoftext|>", "it's 12\u0663\u4e00\U0001f600!!", " " * 3000 + "x", " " * 3000 + "<|endoftext|>x"]
    for t in some:
        assert ours(t).tolist() == theirs.encode(t, add_special_tokens=False).ids
    theirs.encode_special_tokens = True
    for t in some:
        assert plain(t).tolist() == theirs.encode(t, add_special_tokens=False).ids


def test_packing(spark, docs, texts):
    got = packing.pack(spark, docs).toPandas()
    encode, ids = _tokens.encoder(_tokens.default_vocabulary()), {}
    for i, t in texts.items():
        ids[i] = np.append(encode(t), np.uint32(1)).astype("<u4")
    for i, of in got.sort_values(["doc_id", "start"]).groupby("doc_id"):
        assert (of["start"] == of["length"].cumsum() - of["length"]).all() and of["length"].sum() == len(ids[i]) and (of["doc_tokens"] == len(ids[i])).all()
        assert [zlib.crc32(ids[i][a : a + n]) for a, n in zip(of["start"], of["length"], strict=True)] == of["ids_crc32"].tolist()
    padding = total = 0
    for _, of in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        n = of["length"].sum()
        assert (of["offset"] == of["length"].cumsum() - of["length"]).all() and n <= 2048
        padding, total = padding + (0 if n & (n - 1) == 0 else 2048 - n), total + n
    assert padding <= 0.02 * total + 2048
    assert got["sequence_id"].nunique() == got["sequence_id"].max() + 1


@given(st.integers(1, 20_000))
def test_cut(n):
    pieces = packing.cut(n)
    assert sum(x for x, _ in pieces) == n
    for x, k in pieces:
        assert x * k <= 2048 < x * (k + 1)
        assert 2048 / k - x <= max(x / 64, 16 * 16 / 2048 + 1)


@given(st.integers(1, 3000), st.integers(0, 2**62))
@settings(max_examples=50, deadline=None)
def test_permutation(n, key):
    p = training_order.permute(np.arange(n), n, key)
    assert sorted(p.tolist()) == list(range(n))
    assert (training_order.permute(p, n, key, inverse=True) == np.arange(n)).all()


@given(st.lists(st.integers(0, 60), min_size=1, max_size=9), st.integers(0, 2**62))
@settings(max_examples=50, deadline=None)
def test_order(counts, key):
    order, n = training_order.Order(np.array(counts), key), sum(counts)
    part, local = np.repeat(np.arange(len(counts)), counts), np.concatenate([np.arange(c) for c in counts]).astype(np.int64)
    slots = order.slots(part, local)
    assert sorted(slots.tolist()) == list(range(n))
    back = order.sequences(slots)
    assert (back[0] == part).all() and (back[1] == local).all()


def test_order_is_spread():
    order = training_order.Order(np.array([4000, 1000, 10, 0]), 5)
    slots = order.slots(np.zeros(4000, np.int64), np.arange(4000))
    assert abs(np.corrcoef(slots, np.arange(4000))[0, 1]) < 0.1
    assert (np.abs(np.bincount(slots // 501, minlength=10) - 400) < 80).all()


def test_shards(spark, docs, texts, tmp_path):
    d = docs.repartition(3, "doc_id")
    got = training_order.write_shards(spark, d, str(tmp_path / "s"), 9, length=256, shard=64).toPandas().sort_values("slot")
    n = len(got)
    read = list(training_order.read_slots(spark, str(tmp_path / "s"), 0, n + 10, length=256, shard=64))
    assert [r[0] for r in read] == list(range(n)) and [zlib.crc32(r[2]) for r in read] == got["ids_crc32"].tolist()
    assert [r[0] for r in training_order.read_slots(spark, str(tmp_path / "s"), 70, 150, length=256, shard=64)] == list(range(70, 150))
    counts = np.bincount(got["part"], minlength=got["parts"].iloc[0])
    assert training_order.Order(counts, 9).slots(got["part"], got["local"]).tolist() == list(range(n))
    assert (got["shard"] == got["slot"] // 64).all() and (got["record"] == got["slot"] % 64).all()
    streams = defaultdict(dict)
    for (_, _, ids), part, local in zip(read, got["part"], got["local"], strict=True):
        streams[part][local] = ids
    encode = _tokens.encoder(_tokens.default_vocabulary(), special=False)
    wanted = Counter(tuple(encode(t).tolist()) for t in texts.values())
    found, firsts = Counter(), {}
    for part, of in streams.items():
        stream = np.concatenate([of[i] for i in range(len(of))])
        ends = np.flatnonzero(stream == 50256)
        assert ends[-1] == len(stream) - 1
        found.update(tuple(x.tolist()) for x in (stream[a:b] for a, b in zip(np.append(0, ends[:-1] + 1), ends, strict=True)))
        firsts[part] = stream
    assert found == wanted
    for r in got.itertuples():
        own = np.append(encode(texts[r.doc_id]), 50256)
        piece = firsts[r.part][r.local * 256 : r.local * 256 + min(256, len(own) - r.doc_start)][: r.n_ids]
        assert (piece == own[r.doc_start : r.doc_start + len(piece)]).all()


def test_base_spans():
    texts = ['password: "abcdefgh1" API_KEY=short token =  xyz/1234567 AKIA' + "A" * 12 + " AKIAB " + "0f" * 16 + "g" + "a" * 31, "SECRET='" + "ab" * 20 + "' ſecret=abcdefghij passwd:abcdefgh", ""]
    pattern = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
    for t in texts:
        wanted = [("assign", *m.span()) for m in pattern.finditer(t) if len(m[2]) >= 8] + [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16] + [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        assert sorted(secret_scan.base_spans(t)) == sorted(wanted)


def tlv(tag, *content):
    data = b"".join(content)
    n = len(data)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x82]) + n.to_bytes(2)) + data


def test_structures():
    import base64

    rng = np.random.default_rng(1)
    number = lambda n: tlv(2, b"\x01" + rng.bytes(n))
    rsa = tlv(0x30, tlv(2, b"\0"), number(128), number(3), *(number(64) for _ in range(6)))
    pkcs8 = tlv(0x30, tlv(2, b"\0"), tlv(0x30, tlv(6, b"\x2b\x65\x70")), tlv(4, tlv(4, rng.bytes(32))))
    public = tlv(0x30, tlv(0x30, tlv(6, b"\x2a\x86\x48"), tlv(5)), tlv(3, b"\0" + rng.bytes(140)))
    text = lambda b: base64.b64encode(b).decode()
    url = lambda b: base64.urlsafe_b64encode(b).decode().rstrip("=")
    field = lambda b: len(b).to_bytes(4) + b
    ssh = field(b"ssh-ed25519") + field(rng.bytes(32))
    token = f"{url(b'{"alg":"HS256","typ":"JWT"}')}.{url(b'{"sub":"1"}')}.{url(rng.bytes(32))}"
    kinds = lambda t: [k for k, _, _ in secret_scan.confirmed_spans(t)]
    assert kinds(f"x {text(rsa)} y") == ["private_key"] and kinds(text(pkcs8)) == ["private_key"] and kinds(text(public)) == ["public_key"]
    assert kinds(f"ssh-ed25519 {text(ssh)} me@host") == ["ssh_key"] and kinds(f"key {rsa.hex()}.") == ["private_key"]
    pem = f"-----BEGIN PRIVATE KEY-----\n{text(pkcs8)[:64]}\n{text(pkcs8)[64:]}\n-----END PRIVATE KEY-----"
    assert secret_scan.confirmed_spans(f"a {pem} b") == [("private_key", 2, 2 + len(pem))]
    assert secret_scan.confirmed_spans(f"auth {token}.") == [("signed_token", 5, 5 + len(token))]
    for bad in (text(rsa[:-1]), text(rsa + b"x"), text(rng.bytes(200)), token.replace("ey", "ez", 1), url(b'{"typ":"JWT","x":"yyyyyyyyyyyyyyyyy"}') + ".e30.abcdefgh", rsa.hex()[:-2]):
        assert kinds(bad) == []
    spans = secret_scan.ordered(secret_scan.base_spans(f"token={token}") + secret_scan.confirmed_spans(f"token={token}"))
    assert secret_scan.redact(f"token={token} z", spans) == "[SECRET] z"


def test_language(spark, docs, data):
    got = language_id.identify(spark, docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got["held_out"]]
    assert (held["lang"] == held["lang_pred"]).mean() > 0.95 and got["score"].between(0, 1).all()
    assert not got["rejected"].any()
    model = language_id.train(spark, docs)
    for text in ("Привет, как у тебя дела сегодня вечером", "xqzjkv wqxzzk jqxv zzxqk vvkqj"):
        *_, far = language_id.judge(model, [text * 3], language_id.calibrate(spark, docs, model))
        assert far[0]


def test_probabilities_sum_to_one():
    keys, _, _ = language_id._grams(["abracadabra banana abab", "cab dab"], 3)
    counts = {"x": language_id._sum_by_key(keys, np.ones(len(keys), np.int64)), "y": language_id._sum_by_key(keys[:9], np.ones(9, np.int64))}
    model = language_id.build(counts, 3)
    symbols = np.append(np.unique(keys & 65535), 60000)  # and one never seen
    for context in (*np.unique(keys >> 16), 12345):
        p = model.probability((context << 16) | symbols, 3)
        assert np.allclose(p.sum(axis=0), 1, atol=1e-5)


def test_quality(spark, data):
    got = queries.QUERIES["op2_rule_ensemble"](spark, data.replace("sf0.001", "sf0.01")).join(spark.read.parquet(data.replace("sf0.001", "sf0.01") + "/labels.parquet"), "doc_id").toPandas()
    held = got[got["held_out"]]
    good, bad = held[held["quality"] == 1]["score"], held[held["quality"] == 0]["score"]
    assert np.mean([(x > y) + (x == y) / 2 for x in good for y in bad]) > 0.95


def test_ann_recall(spark, data):
    got = queries.QUERIES["op6_multi_index_hashing"](spark, data).toPandas()
    e = spark.read.parquet(f"{data}/embeddings.parquet").toPandas()
    ids, v = e["vec_id"].to_numpy(), np.stack(e["embedding"].to_numpy()).astype(float)
    hits = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = v @ v[i]
        s[i] = -np.inf
        near = ids[np.lexsort((ids, -s))[:20]]
        own = got[got["query_id"] == ids[i]].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21)) and np.allclose(own["score"], v[[np.flatnonzero(ids == x)[0] for x in own["vec_id"]]] @ v[i])
        hits, total = hits + len(set(near) & set(own["vec_id"])), total + 20
    assert hits / total >= 0.9


def test_probing_finds_all_within_radius():
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 256, (500, 16), dtype=np.uint8)
    index = ann.Index(codes)
    for r in (0, 15, 40, 60):
        d = np.bitwise_count(codes ^ codes[7]).sum(axis=1)
        assert index.within(codes[7], r).tolist() == np.flatnonzero(d <= r).tolist()


def test_decontamination(spark):
    rng = np.random.default_rng(2)
    items = [" ".join(f"i{j}w{rng.integers(200)}" for _ in range(n)) for j, n in enumerate((12, 30, 45, 60, 3))]
    noise = lambda n: " ".join(f"n{rng.integers(5000)}" for _ in range(n))
    texts, wanted = [], set()
    for j, item in enumerate(items):
        texts.append(f"{noise(50)} {item.upper()}! {noise(30)}")
        wanted.add((len(texts) - 1, j))
        w = item.split()
        if len(w) >= 45:  # one word changed of many keeps the similarity
            texts.append(f"{noise(9)} {' '.join([*w[:2], 'other', *w[3:]])} {noise(9)}")
            wanted.add((len(texts) - 1, j))
        if len(w) > 5:
            texts.append(f"{noise(9)} {' '.join(w[: len(w) // 2])} {noise(20)}")  # half isn't alike
    texts += [noise(400), ""]
    got = decontamination.contaminated(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == wanted
    for r in got:  # against every window of that size
        w = [x.lower() for x in re.findall(r"\w+", texts[r["doc_id"]])]
        item = [x.lower() for x in re.findall(r"\w+", items[r["item_id"]])]
        k = min(5, len(item))
        bag = lambda x, k=k: Counter(tuple(x[i : i + k]) for i in range(len(x) - k + 1))
        best = max((bag(w[i : i + len(item)]) & bag(item)).total() / (bag(w[i : i + len(item)]) | bag(item)).total() for i in range(len(w) - len(item) + 1))
        assert r["similarity"] == pytest.approx(best)


def test_benchmark_in_blocks(spark, data, monkeypatch):
    docs, benchmark = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "benchmark"))
    once = sorted(tuple(r) for r in decontamination.contaminated(spark, docs, benchmark).collect())
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 3000)
    assert once and sorted(tuple(r) for r in decontamination.contaminated(spark, docs, benchmark).collect()) == once


def test_chat_equals_sql(spark, data):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{data}/conversations.parquet'")
    df = queries.QUERIES["op5_preference_format"](spark, data)
    theirs = con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLE_SQL['op5_preference_format']})").fetchall()
    assert sorted(tuple(r) for r in df.collect()) == sorted(theirs)
    assert {r["part"] for r in df.select("part").distinct().collect()} == {"prompt", "chosen", "rejected"}


def test_chat_stays_in_the_jvm(spark, data):
    plan = queries.QUERIES["op5_preference_format"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_slices(spark):
    df = spark.createDataFrame([(i, "x" * (i * 700_000)) for i in range(30)], "doc_id long, text string").coalesce(1)

    def run(batches):
        for b in _shared.slices(batches):
            assert sum(len(t) for t in b.column(1).to_pylist()) < (9 << 20) + 30 * 700_000
            yield b

    assert df.mapInArrow(run, df.schema).agg(F.sum(F.length("text"))).first()[0] == sum(i * 700_000 for i in range(30))


def test_secrets_inside_runs():
    import base64

    rng = np.random.default_rng(2)
    url = lambda b: base64.urlsafe_b64encode(b).decode().rstrip("=")
    sec1 = tlv(0x30, tlv(2, b"\1"), tlv(4, rng.bytes(32)), tlv(0xA0, tlv(6, b"\x2a\x86\x48\xce\x3d\x03\x01\x07")))
    point = tlv(0x30, tlv(0x30, tlv(6, b"\x2a\x86\x48\xce\x3d\x02\x01"), tlv(6, b"\x2a\x86\x48\xce\x3d\x03\x01\x07")), tlv(3, b"\0\2" + rng.bytes(32)))
    token = f"{url(b'{"alg":"HS256"}')}.{url(b'{"sub":"1"}')}.{url(rng.bytes(32))}"
    pretty = f"{url(b'{\n  "alg": "HS256"\n}')}.{url(b'{"sub":"1"}')}.{url(rng.bytes(32))}"
    for kind, secret in (("private_key", base64.b64encode(sec1).decode()), ("public_key", base64.b64encode(point).decode()), ("signed_token", token), ("signed_token", pretty)):
        for before, after in (("", ""), ("https://host.example.com/verify/", " x"), ("v1/k-", ".")):
            assert secret_scan.confirmed_spans(before + secret + after) == [(kind, len(before), len(before) + len(secret))], (before, secret)
    assert secret_scan.confirmed_spans(f"/{token}/next") == [("signed_token", 1, 1 + len(token))]
    assert secret_scan.confirmed_spans(f"0x{sec1.hex()}") == [("private_key", 2, 2 + 2 * len(sec1))]


def test_documents_shorter_than_items(spark):
    words = [f"w{i}" for i in range(59)]
    texts = [" ".join(words[:n]) for n in (55, 50, 45, 59)]
    got = decontamination.contaminated(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == [(0, 7, 51 / 55, 0, 55), (1, 7, 46 / 55, 0, 50), (3, 7, 1.0, 0, 59)]


def test_language_left_out(spark, data):
    docs = spark.read.parquet(data.replace("sf0.001", "sf0.1") + "/documents.parquet").select("doc_id", "text", "lang").repartition(4)
    learn = docs.where((language_id.remainder(3) != 1) & (F.col("lang") != "en"))
    model = language_id.train(spark, learn)
    got = language_id.score(spark, docs.where((F.col("lang") == "en") & (F.col("doc_id") % 4 == 0)), model, language_id.calibrate(spark, learn, model))
    assert got.where("not rejected").count() < 0.2 * got.count()


def thue_morse(n, a, b):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def test_words_of_one_polynomial_hash_differ(spark):
    """Two words, and two runs of words, that every polynomial modulo 2**64 with an odd base takes for one."""
    x, y = thue_morse(2048, "a", "b"), thue_morse(2048, "b", "a")
    h, _ = _hashing.word_hashes([f"{x} {y}".encode()], False)
    assert h[0] != h[1]
    rest = " ".join(f"w{i}" for i in range(25))
    texts = {1: f"{rest} {x}", 2: f"{rest} {y}", 3: x, 4: y, 5: f"{rest} {x}"}
    texts |= {i: " ".join(w for c in thue_morse(2048, p, q) for w in (c,)) for i, p, q in ((8, "a", "b"), (9, "b", "a"))}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    sets = shingle_sets(texts, 4)
    assert {r["doc_id"]: r["component_id"] for r in near_dups.link(spark, df, 4).collect()} == brute_components(sets)
    assert {r[0]: tuple(r)[1:] for r in substring_dedup.dedup_digest(spark, df).collect()} == brute_dedup(texts)


def test_sets_in_parts(spark, docs, texts, monkeypatch):
    """Sets of many rows, and cells of few nodes, give what whole sets give."""
    wanted = brute_components(shingle_sets(texts, 4))
    monkeypatch.setattr(near_dups, "PART", 50)
    monkeypatch.setattr(near_dups, "BLOCK_NODES", 3)
    monkeypatch.setattr(near_dups, "BLOCK_SHINGLES", 400)
    assert {r["doc_id"]: r["component_id"] for r in near_dups.link(spark, docs, 4).collect()} == wanted


def test_statistics_against_plain_counts(texts):
    some = [*list(texts.values())[:40], "", " \n ", "one", "A b A b\n\nA b c!"]
    got = quality.statistics([t.encode() for t in some])
    at = quality.FEATURES.index
    for t, x in zip(some, got, strict=True):
        words = WORD.findall(lower(t))
        lines = [y for y in t.encode().split(b"\n") if y]
        distinct = lambda k, w=words: len({tuple(w[i : i + k]) for i in range(len(w) - k + 1)}) / (len(w) - k + 1) if len(w) >= k else 1.0
        wanted = {"log_bytes": np.log1p(len(t.encode())), "log_words": np.log1p(len(words)), "mean_word": len(t.encode()) / max(1, len(words)), "upper_share": sum("A" <= c <= "Z" for c in t) / max(1, len(t.encode()))}
        if words:
            counts = Counter(words)
            wanted |= {"distinct_words": len(counts) / len(words), "top_word_share": max(counts.values()) / len(words), "other_words": sum(n == 1 for n in counts.values()) / len(words), "distinct_pairs": distinct(2), "distinct_fives": distinct(5)}
            wanted |= {"longest_word": max(len(w.encode()) for w in words), "distinct_lines": len(set(lines)) / len(lines), "words_per_line": len(words) / len(lines)}
        for k, v in wanted.items():
            assert x[at(k)] == pytest.approx(v), (k, t)


def test_rules_as_a_column(spark, docs, data):
    """The compiled expression gives what the ensemble gives, and the fit doesn't depend on how rows are dealt."""
    labels = spark.read.parquet(f"{data}/labels.parquet")
    model = quality.train(spark, docs, labels)
    assert model.rules
    rows = quality.with_statistics(docs, "doc_id", "long").select(*quality.FEATURES, model.column().alias("p")).toPandas()
    assert rows["p"].to_numpy() == pytest.approx(model.predict(rows[list(quality.FEATURES)].to_numpy()))
    again = quality.train(spark, docs.repartition(7), labels.repartition(3))
    assert again.bias == model.bias and again.weights == model.weights and again.rules == model.rules


def test_scan_of_documents(spark, docs, texts):
    """Counts, order and digest of every document's base spans by the patterns as the contract has them; offsets count code points."""
    assign = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A)
    more = {-1: "\U0001f600é token: abcdefgh1 AKIA" + "B" * 16 + " " + "0a" * 20, -2: "secret=" + "ab" * 20}
    df = docs.select("doc_id", "text").union(spark.createDataFrame(list(more.items()), "doc_id long, text string"))
    for r in secret_scan.scan(df).collect():
        t = (texts | more)[r["doc_id"]]
        kinds = [[m.span() for m in assign.finditer(t) if len(m[2]) >= 8], [m.span() for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16], [m.span() for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]]
        written = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted((a, k, b) for k, of in enumerate(kinds) for a, b in of))
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(map(len, kinds)) and r["base_sha256"] == hashlib.sha256(written.encode()).hexdigest()
        assert set(written.split(",")) - {""} <= set(r["spans"].split(","))


def kneser_ney(counts, order, symbols):
    """P(c | history) of one language from its n-gram counts, by the definition."""
    by = {order: counts}
    for n in range(order - 1, 0, -1):
        by[n] = Counter(g[1:] for g in by[n + 1])

    def p(gram):
        n = len(gram)
        if not n:
            return 1 / (symbols + 1)
        mine = by[n]
        once, twice = sum(c == 1 for c in mine.values()), sum(c == 2 for c in mine.values())
        d = once / (once + 2 * twice) if once and twice else 0.5
        same = [c for g, c in mine.items() if g[:-1] == gram[:-1]]
        if not same:
            return p(gram[1:])
        return (max(mine[gram] - d, 0) if gram in mine else 0) / sum(same) + d * len(same) / sum(same) * p(gram[1:])

    return p


def test_kneser_ney_by_definition(spark):
    texts = {"x": ["the cat sat on the mat", "中文字符 𠀀𠀁 the cat", "a man, a plan"], "y": ["el gato está aquí", "uno dos uno"]}
    rows_ = [(i, t, x) for i, (x, t) in enumerate((x, t) for x, of in texts.items() for t in of)]
    model = language_id.train(spark, spark.createDataFrame(rows_, "doc_id long, text string, lang string"))
    grams, order = {}, language_id.ORDER
    for x, of in texts.items():
        c = Counter()
        for t in of:
            s = "\0" * (order - 1) + re.sub(" +", " ", "".join(ch if ch.isalpha() else " " for ch in t.lower()))
            c.update(s[i - order + 1 : i + 1] for i in range(order - 1, len(s)))
        grams[x] = c
    symbols = len({g[-1] for c in grams.values() for g in c})
    probability = {x: kneser_ney(c, order, symbols) for x, c in grams.items()}
    code = lambda ch: 0 if ch == "\0" else int(language_id._fold()[ord(ch)])
    for x, c in grams.items():
        for g in [*c, *list(grams["x"])[:10], "zzzz", "\0\0qe"]:
            key = np.array([sum(code(ch) << (16 * (order - 1 - i)) for i, ch in enumerate(g))], dtype=object).astype(np.uint64).view(np.int64)
            assert model.probability(key, order)[0, model.langs.index(x)] == pytest.approx(probability[x](g), rel=1e-4), (x, g)


def test_marks_alone_are_no_letters():
    model = language_id.Model(["x"], 4, *([[np.zeros(0, np.int64)] * 5, [np.zeros((0, 1), np.float32)] * 5] * 2), 0.1)
    lang, *_ = language_id.judge(model, ["\u0301\u0302", "e\u0301", "", "12 3"], None)
    assert lang == ["und", "x", "und", "und"]


def test_codes_within_a_radius():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 2**63, 400, np.int64).astype(np.uint64)
    codes[200:] = codes[:200] ^ (np.uint64(1) << rng.integers(0, 63, 200).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 63, 200).astype(np.uint64))
    blocks = decontamination.Blocks(codes)
    asked = np.concatenate([codes[:50], rng.integers(0, 2**63, 50, np.int64).astype(np.uint64)])
    who, item = blocks.within(asked)
    wanted = np.nonzero(np.bitwise_count(codes[None, :] ^ asked[:, None]) <= decontamination.RADIUS)
    assert who.tolist() == wanted[0].tolist() and item.tolist() == wanted[1].tolist()
    assert [x.tolist() for x in blocks.within(asked[:0])] == [[], []]
