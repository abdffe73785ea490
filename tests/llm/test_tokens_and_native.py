"""Token operators against the libraries, and the two operators of DataFrame functions."""

import base64
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import op2_token_counts, op5_bpe, op6_token_output, op8_url_filters, op10_license_scan
from folioscope.llm.files import write_whole

public = pytest.importorskip("public_tokenizers")
TEXTS = [
    "", None, "Hello world", " leading", "trailing ", "two  spaces", "tab\tand\nnew \n lines\r\n", "don't we'll I'M", "naïve façade 你好 мир 😀", "x" * 3000, "a1b2 c3,d4... (e5)!", "\u00a0nbsp\u2003em", "\x1c odd \x85 space", "$$$ ### ***", "word,word;word", "' 'quoted' '", "end.\n\n\n",
    "été, où? ça!", "mixed—dash “quotes”", "🏳️‍🌈 flag", "١٢٣ arabic-digits ٤", "<|endoftext|> is a token", "a <|endoftext|> b", "<|endoftext|><|endoftext|>", "<|endoftext|ended", "caf\u00e9<|endoftext|>  two  ",
]


def documents(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (2, "Hello world")], "doc_id long, text string").withColumn("ids", F.lit("clash"))


def sha(data) -> str:
    return hashlib.sha256(data).hexdigest()


def rank_encoding():
    import tiktoken

    path = public.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return path, tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("block", [5, 12_000_000])
def test_bpe_round_trip(spark, monkeypatch, block):
    monkeypatch.setattr(op5_bpe, "BLOCK_CHARS", block)
    path, enc = rank_encoding()
    rows = op5_bpe.encode_and_decode(documents(spark), path, public.PATTERN).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        text = "no id" if r["doc_id"] is None else TEXTS[r["doc_id"]] or ""
        ids = enc.encode_ordinary(text)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(text.encode())), text
    apart = op5_bpe.decode(op5_bpe.encode(documents(spark), path, public.PATTERN), path).collect()
    assert sorted(sha(r["decoded"]) for r in apart) == sorted(r["decoded_sha256"] for r in rows)
    assert op5_bpe.encode_and_decode(documents(spark).limit(0), path, public.PATTERN).count() == 0


def test_packing():
    for n in ([], [0], [1, 2**32 - 1, 70_000], list(range(1000))):
        assert op5_bpe._unpack(op5_bpe._pack(np.array(n, np.uint32))).tolist() == n


def test_token_counts(spark, monkeypatch):
    path, enc = rank_encoding()
    end = len(op5_bpe.ranks_of(path))
    monkeypatch.setattr(op2_token_counts, "BLOCK_IDS", 100)
    long = [(1000, "many words " * 50_000), (1000, None)]
    docs = documents(spark).select("doc_id", "text").union(spark.createDataFrame(long, "doc_id long, text string"))
    got = op2_token_counts.count_document_tokens(docs, path, public.PATTERN, end)
    joins = re.findall(r"(\w+Join) \[(?:name|file)#\d+L?, (?:number|first)", got._jdf.queryExecution().executedPlan().toString())
    assert joins and set(joins) == {"SortMergeJoin"}
    key = lambda r: (r[0] is None, r)
    want = [(r["doc_id"], len(enc.encode_ordinary(r["text"] or ""))) for r in docs.collect()]
    assert sorted(((r["doc_id"], r["n_tokens"]) for r in got.collect()), key=key) == sorted(want, key=key)
    assert op2_token_counts.count_document_tokens(documents(spark).limit(0), path, public.PATTERN, end).count() == 0


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1000])
def test_separator_scan_across_blocks(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(op2_token_counts, "RUN", 2)
    streams = [[9, 1, 2, 9, 9, 3, 4, 5, 6, 7, 8, 9], [1, 2, 3], [9], [1, 9, 2, 9, 3]]
    files = []
    for s in streams:
        uri = write_whole(f"file://{tmp_path}", "t", lambda out, s=s: out.write(np.array(s, "<u2").tobytes()))
        files.append((uri, 2 * len(s)))
    got = op2_token_counts.count_tokens(spark.createDataFrame([*files, ("file:///none", 0)], "file string, bytes long"), 9, 2, block).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r["file"], r["number"])):
        found.setdefault(r["file"], []).append((r["n_tokens"], r["ended"]))
    want = [[(0, True), (2, True), (0, True), (6, True)], [(3, False)], [(0, True)], [(1, True), (1, True), (1, False)]]
    assert [found[f] for f, _ in files] == want


def test_token_shards(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    shards = op6_token_output.write(documents(spark), public.path("byte_bpe_50k.json"))
    rows = sorted(op6_token_output.read(shards).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, 0, 1, 2, 2, *range(3, len(TEXTS))]
    start = 0
    for r in rows:
        ids = [*t.encode("no id" if r["doc_id"] is None else TEXTS[r["doc_id"]] or "", add_special_tokens=False).ids, 0]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), r
        start += len(ids)
    store = op6_token_output.Store(shards)
    assert len(store.get(2)) == 2 and len(store.get(None)) == 1 and store.get(10**6) == []
    assert store.get(9)[0].tolist() == [*t.encode(TEXTS[9], add_special_tokens=False).ids, 0]
    assert op6_token_output.read(op6_token_output.write(documents(spark).limit(0), public.path("byte_bpe_50k.json"))).count() == 0


def test_shards_of_ranges_and_other_files(spark, tmp_path):
    """Lookups open only shards whose range holds the key, equal keys in two shards included; other kinds of files are refused."""
    import json

    path = public.path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(i // 3, f"w{i} " * (i % 7)) for i in range(-30, 300)], "doc_id long, text string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    shards = op6_token_output.write(docs, path).cache()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    store = op6_token_output.Store(shards)
    assert len(store.uris) > 1 and all(len(store.get(i)) == 3 for i in range(-10, 100))
    store = op6_token_output.Store(shards)
    assert store.get(50) and len(store.open) <= 2 and store.get(1000) == []
    said = json.load(open(path))
    for k, v in (("normalizer", {"type": "NFC"}), ("pre_tokenizer", said["pre_tokenizer"] | {"add_prefix_space": True})):
        other = tmp_path / f"{k}.json"
        other.write_text(json.dumps(said | {k: v}))
        with pytest.raises(ValueError):
            op6_token_output.Encoder(str(other))


def test_shard_blocks_and_damage(tmp_path, monkeypatch):
    monkeypatch.setattr(op6_token_output, "BLOCK_BYTES", 40)
    ids = [-5, -1, 0, 1, 1, 1, 2, 255, 256, 1 << 40]

    def write(out):
        w = op6_token_output.ShardWriter(out, 4)
        for i, d in enumerate(ids):
            w.add(d, np.arange(i, dtype=np.uint32))
        w.close()

    uri = write_whole(f"file://{tmp_path}", "s", write)
    shard = op6_token_output.Shard(uri)
    assert [d for d, _ in shard] == ids and len(shard.index) > 3 and [len(x) for x in shard.get(1)] == [3, 4, 5]
    assert [len(x) for x in shard.get(1 << 40)] == [9] and shard.get(3) == [] and shard.get(None) == []
    path = uri.removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    data[-80] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(ValueError):
        op6_token_output.Shard(uri)


def test_url_filters(spark):
    urls = [
        ("https://A.Example.COM/en/7?x", "a.example.com", "/en/7", "example.com/en/7", "allow"), ("http://b.com/en/x", "b.com", "/en/x", "com/en/", "block"), ("http://example.net/de/81#z", "example.net", "/de/81", "example.net/de/8", "block"),
        ("http://example.net/de/9", "example.net", "/de/9", "net/de/", "block"), ("http://x.org/es/", "x.org", "/es/", "org/es/", "block"), ("http://x.org/ES/", "x.org", "/ES/", None, "allow"), ("http://notexample.com/fr", "notexample.com", "/fr", None, "allow"),
        ("http://my.casino-win.fr/a", "my.casino-win.fr", "/a", None, "block"), ("http://casinos.fr/", "casinos.fr", "/", None, "allow"), ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("://h?q", "h", "", None, "allow"),
        ("a://b://com/en/", "b:", "//com/en/", None, "allow"), ("http://e.com/" + "p/" * 20_000, "e.com", "/" + "p/" * 20_000, None, "allow"),
    ]
    rows = [(i, u[0]) for i, u in enumerate(urls)] + [(1, urls[1][0]), (None, urls[1][0])]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("token", F.lit("clash")).withColumn("host", F.lit("clash"))
    got = op8_url_filters.filter_urls(df).collect()
    assert len(got) == len(rows)
    for r in got:
        u = urls[1 if r["page_id"] is None else r["page_id"]]
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == u[1:], u[0][:60]
    assert op8_url_filters.filter_urls(df.limit(0)).count() == 0
    loose = (op8_url_filters.Rule("*oo*", "block"),)
    twice = spark.createDataFrame([(1, "http://foo/"), (1, "http://foo/"), (2, "http://f/")], "page_id long, url string")
    assert [r["verdict"] for r in op8_url_filters.filter_urls(twice, loose).orderBy("page_id").collect()] == ["block", "block", "allow"]
    rules = (op8_url_filters.Rule("||com/en/", "block"), op8_url_filters.Rule("||example.com/en/7", "allow"), *loose)
    table = op8_url_filters.rule_table(op8_url_filters.rules_frame(spark, rules)).collect()
    assert [sorted(r["token"] for r in table if r["rule_no"] == i) for i in range(3)] == [["com", "en"], ["com", "en", "example"], [""]]
    same = (op8_url_filters.Rule("||a.b/c", "allow", True), op8_url_filters.Rule("||b/c*d", "block", True), op8_url_filters.Rule("||a.b/?", "block", True))
    assert op8_url_filters.filter_urls(spark.createDataFrame([(1, "http://a.b/cd")], "page_id long, url string"), same).first()["rule"] == "a.b/c"


def test_listed_url_rules_are_the_contract_s(spark):
    """Each rule of the contract by its own word, also where a wider or a longer one fits or the method's own list would block."""
    contract = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    assert {r.pattern.removeprefix("||"): r.verdict for r in op8_url_filters.LISTED} == contract
    urls = {"http://b.com/en/x": "com/en/", "http://example.com/en/71": "example.com/en/7", "http://example.net/de/9": "net/de/", "http://casino.b.net/de/": "net/de/", "http://www.example.net/de/8": "example.net/de/8", "http://x.org/es/": "org/es/"}
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in op8_url_filters.filter_urls(pages).collect()}
    assert got == {i: (rule, contract[rule]) for i, rule in enumerate(urls.values())}


def test_many_url_rules_from_a_file(spark, tmp_path, monkeypatch):
    """Tens of thousands of rules, which run only where their rarest token stands, by broadcast and by shuffle."""
    path = tmp_path / "rules.txt"
    path.write_text("! remark\n[list]\n\n" + "".join(f"||host{i}.example^\n" for i in range(20_000)) + "@@||host7.example/open^\n/banner*.gif$image\n")
    rules = op8_url_filters.read_rules(spark, str(path))
    urls = [f"http://www.host{i}.example/x" for i in range(19_000, 21_000)] + ["http://host7.example/open/a", "http://host7.example/", "http://q.org/a/Banner-1.GIF", "http://host1.examples/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    want = ["block" if i < 20_000 else "allow" for i in range(19_000, 21_000)] + ["allow", "block", "block", "allow"]
    for most in (op8_url_filters.MAX_RULES, 10):
        monkeypatch.setattr(op8_url_filters, "MAX_RULES", most)
        got = sorted((r["page_id"], r["verdict"], r["n_rules_run"]) for r in op8_url_filters.filter_urls(pages, rules).collect())
        assert [v for _, v, _ in got] == want and max(n for _, _, n in got) <= 3


def test_license_scan(spark):
    mit = next(t.text for t in op10_license_scan.LONGER if t.text.startswith("permission is hereby granted free"))
    texts = [
        None, "", "MIT License", "mit  license, mit-license; CC BY-NC 4.0", "the apache\nlicense and the GNU General Public License v3", "mit licenses", "x " * 100_000 + "cc by", mit.upper(), mit.replace("any person ", "any ").replace("free of charge", "free of all charge"), "apache", "mit é license", "CC_BY",
    ]
    rows = [(i, t) for i, t in enumerate(texts)] + [(2, "MIT License"), (2, "other"), (None, "cc by")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    got = op10_license_scan.scan_licenses(df).collect()
    assert len(got) == len(rows)
    word = re.compile(op10_license_scan.WORD)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    want = []
    for i, t in rows:
        w = word.findall((t or "").translate(lower))
        at = sorted((j, p.label) for p in op10_license_scan.BASE for j in range(len(w)) if w[j : j + len(p.words)] == p.words)
        want.append((i, len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at}))))
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got), key=key) == sorted(want, key=key)
    by = {r["doc_id"]: r for r in got}
    assert by[7]["labels"] == "mit" and by[7]["score"] == 1 and by[7]["base_labels"] == "" and by[8]["labels"] == "mit" and 0.7 <= by[8]["score"] < 1
    assert all(0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in got)
    assert op10_license_scan.scan_licenses(df.limit(0)).count() == 0


def test_license_spans_are_verified(spark):
    """A whole text with edits is found; the same words pulled apart, or in another order, are not."""
    mit = next(t for t in op10_license_scan.LONGER if t.label == "mit" and len(t.words) > 150)
    w = mit.words
    edits = " ".join(x for i, x in enumerate(w) if i % 25 != 7)
    apart = " ".join(f"{a} {b} foreign" for a, b in zip(w[::2], w[1::2], strict=False))
    apart4 = " ".join(" ".join(w[i : i + 4]) + " one two three four five six" for i in range(0, len(w), 4))
    mixed = " ".join(" ".join(w[i : i + 5]) for i in sorted(range(0, len(w), 5), key=lambda i: (i * 7) % 11))
    twice = mit.text + " other " * 30 + mit.text
    rows = [(1, mit.text), (2, edits), (3, apart), (4, apart4), (5, mixed), (6, twice), (7, "of the software " * 20_000)]
    got = {r["doc_id"]: r for r in op10_license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["labels"] for i in range(1, 8)] == ["mit", "mit", "", "", "", "mit", ""]
    assert got[1]["score"] == got[6]["score"] == 1 and 0.8 < got[2]["score"] < 1


def test_license_oracle(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    texts = [t.text for t in op10_license_scan.LONGER] + [" ".join(x for i, x in enumerate(t.words) if i % 9) for t in op10_license_scan.LONGER] + [None, "", "cc by", "x cc by cc by mit license"]
    df = spark.createDataFrame([(i, "intro " * (i % 4) + t if t else t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = sorted(tuple(r) for r in op10_license_scan.scan_licenses(df).collect())
    documents = df.toPandas()  # noqa: F841
    assert got == sorted(duckdb.sql(op10_license_scan.ORACLE).fetchall(), key=lambda r: r[0])
