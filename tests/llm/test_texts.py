"""Token ids against the public libraries and exact round trips, packing against its constraints, personal items against labelled lines."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.llm import packing, privacy, queries, tokens
from seqloom.llm.bpe import FULL, Bpe, default_path, load, pieces
from seqloom.llm.names import NameModel, parts
from seqloom.llm.pii import Detector
from seqloom.llm.surrogates import Surrogates

DOCS = "doc_id bigint, text string"


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), DOCS)


# ---- tokens ----

ODD = [
    None, "", " ", "\n\n", "a", "it's we'll 'S", "\r\n\r\n  a\t\tb", "x" * 20_000, " " * 3000, "é" * 400, "ठीक किया 👩🏽‍💻 wip", "a\x1c\x1cb 　 c", "<|endoftext|> hi", "1½²x ___ --- ​",
    "line one\n    let x = 1;\n\n\n  é = \"naïve\"\n\tend \n", "日本語\n日本語 \nascii\n \n",
]


@pytest.fixture(scope="module")
def public():
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_ids_equal_the_public_library(public):
    bpe = load(default_path())
    r = random.Random(1)
    made = ["".join(r.choice(" \n\t\r\x1c éaZ1½'s._漢👍") for _ in range(r.randint(1, 50))) for _ in range(1500)]
    for text in [t for t in ODD if t] + made:
        assert bpe.encode(text) == public(text), repr(text[:80])


def test_pieces_are_those_of_the_pattern():
    r = random.Random(2)
    for _ in range(3000):
        text = "".join(r.choice(" \n\n\r\t aZ9é漢'") for _ in range(r.randint(0, 40)))
        assert pieces(text) == FULL.findall(text), repr(text)


def test_merge_is_lowest_rank_first():
    """Against merging step by step over all pairs."""
    bpe = load(default_path())

    def plain(piece):
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            ranked = [(bpe.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in bpe.ranks]
            if not ranked:
                return [bpe.ranks[p] for p in parts]
            i = min(ranked)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    r = random.Random(3)
    for _ in range(600):
        piece = "".join(r.choice("aabcdeéx1漢") for _ in range(r.randint(1, 30))).encode()
        assert bpe.merge(piece) == plain(piece)


def test_round_trip_and_kept_pieces_change_nothing(monkeypatch):
    monkeypatch.setattr("seqloom.llm.bpe.KEPT", 3)
    small, usual = Bpe(default_path()), load(default_path())
    for text in ODD:
        assert small.encode(text) == usual.encode(text)
        assert usual.decode(usual.encode(text)) == (text or "")


def test_token_columns(spark, public):
    df = docs(spark, *ODD).withColumn("ids", F.lit("clash")).withColumn("n_tokens", F.lit(0))
    got = {r["doc_id"]: r["ids"] for r in tokens.token_ids(df).collect()}
    assert got == {i: public(t) if t else [] for i, t in enumerate(ODD)}
    assert tokens.token_ids(df).dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    assert {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(df).collect()} == {i: len(x) for i, x in got.items()}
    assert {r["doc_id"]: r["text"] for r in tokens.decoded(tokens.token_ids(df)).collect()} == {i: t or "" for i, t in enumerate(ODD)}
    assert tokens.token_ids(df.where("false")).count() == 0


# ---- packing ----


def sizes_of(spark, sizes):
    return spark.createDataFrame(list(enumerate(sizes)), "doc_id bigint, n_tokens int")


@pytest.mark.parametrize(("capacity", "documents", "attention"), [(100, 5, 100 * 100), (100, 3, 6000), (64, 100, 64 * 64)])
def test_every_constraint_holds_and_every_token_is_once(spark, capacity, documents, attention):
    r = random.Random(4)
    sizes = [r.choice([0, 1, 2, 7, 30, 50, 63, 99, 100, 101, 250, None]) for _ in range(700)]
    got = packing.pack(sizes_of(spark, sizes), capacity=capacity, documents=documents, attention=attention).toPandas()
    packed = got[got.container.notna()]
    by = packed.groupby("container")
    assert by.n_tokens.sum().max() <= capacity and by.size().max() <= documents and (packed.n_tokens**2).groupby(packed.container).sum().max() <= attention
    most = min(capacity, int(attention**0.5))
    for doc, size in enumerate(sizes):
        mine = packed[packed.doc_id == doc].sort_values("start")
        if not size:
            assert len(mine) == 0 and len(got[got.doc_id == doc]) == 1
            continue
        assert mine.start.tolist() == list(np.cumsum([0, *mine.n_tokens[:-1]])) and mine.n_tokens.sum() == size
        assert len(mine) == -(-size // most) and (size <= most or (mine.n_tokens.iloc[:-1] == most).all())


def test_a_giant_text_fills_its_own_containers(spark):
    got = packing.pack(sizes_of(spark, [2048 * 5000 + 3, 2045, 2048])).toPandas()
    assert got.groupby("container").n_tokens.sum().max() == 2048 and got.container.nunique() == 5002
    assert got[got.doc_id == 0].n_tokens.sum() == 2048 * 5000 + 3 and sorted(got[got.doc_id == 0].piece) == list(range(5001))


def test_little_is_left_empty(spark):
    r = random.Random(5)
    sizes = [min(4000, int(r.lognormvariate(5.5, 1.2)) + 1) for _ in range(5000)]
    filled = packing.fill(packing.pack(sizes_of(spark, sizes))).toPandas()
    assert filled.unused.sum() / (packing.CAPACITY * len(filled)) < 0.01
    assert filled.n_tokens.sum() == sum(sizes)


def test_best_fit_takes_the_fullest_that_fits():
    assert packing.best_fit(np.array([60, 50, 40, 30, 10]), 100, 9, 10**6).tolist() == [0, 1, 0, 1, 1]
    assert packing.best_fit(np.array([], dtype=int)).tolist() == []
    assert len(set(packing.best_fit(np.array([5] * 6), 100, 2, 10**6).tolist())) == 3


def test_repeated_and_null_keys_are_packed_each(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 16)
    df = spark.createDataFrame([(1, 10)] * 50 + [(None, 10)] * 50, "doc_id bigint, n_tokens int")
    got = packing.pack(df, capacity=100).toPandas()
    assert len(got) == 100 and got.groupby("container").n_tokens.sum().max() <= 100
    assert packing.pack(df.where("false")).count() == 0


# ---- names ----

GIVEN, FAMILY = ["Riv", "Bren", "Tor", "Kes"], ["Stav", "Holm", "Quill", "Ever"]
PEOPLE = [f"{g}{a} {f}{b}" for i, (g, a) in enumerate((g, a) for g in GIVEN for a in ("vik", "ira", "dan", "elle")) for f, b in [(f, b) for f in FAMILY for b in ("quist", "mont", "vale", "worth")][i % 4 :: 4]] + ["Rivira O'Stavmont", "Tordan van der Holmvale"]


def test_model_knows_new_combinations():
    heads, tails = parts({p.split()[0] for p in PEOPLE})
    assert heads == set(GIVEN) and tails == {"vik", "ira", "dan", "elle"}
    found = lambda t: [m.group() for m in NameModel(PEOPLE).pattern.finditer(t)]
    assert found("Hi Kesdan, ask Brenelle Holmmont or Holmmont, Brenelle.") == ["Kesdan", "Brenelle Holmmont", "Holmmont, Brenelle"]
    assert found("R. Quillquist's box, TORIRA EVERWORTH, Rivdan-Torvik K. de la Stavvale") == ["R. Quillquist", "TORIRA EVERWORTH", "Rivdan-Torvik K. de la Stavvale"]
    assert found("rivdan Rivdan_x @Rivdan Rivdan@x.org xRivdan path/Rivdan Main Copper") == []
    assert NameModel([]).pattern is None


# ---- items ----

LABELLED = [
    ("Author: Rivvik Holmvale <riv.holm+git@mail.example>", [("name", "Rivvik Holmvale"), ("email", "riv.holm+git@mail.example")]),
    ("Author: dep-updater[bot] <noreply@forge.example>", []),
    ("Author: ci-sync <do-not-reply@forge.example>", []),
    ("Signed-off-by: Nobody Inparticular <n@x.test>", [("name", "Nobody Inparticular"), ("email", "n@x.test")]),
    ("contact: kes_ever at fern dot invalid", [("email", "kes_ever at fern dot invalid")]),
    ("maintainer: Tordan Evermont <t.e[at]quarry.test>", [("name", "Tordan Evermont"), ("email", "t.e[at]quarry.test")]),
    ("see (x (at) post.example) and <y at inkwell.test>", [("email", "x (at) post.example"), ("email", "y at inkwell.test")]),
    ("contact: riv.ira+git%40mx.fern.invalid, <kes dot holm at mx dot fern dot invalid>", [("email", "riv.ira+git%40mx.fern.invalid"), ("email", "kes dot holm at mx dot fern dot invalid")]),
    ('u = "mailto:Kes-A@Mail.Example?subject=x"', [("email", "Kes-A@Mail.Example")]),
    ("Merge tag 'v1' of git@forge.example:team/x.git; ssh deploy@build-6.internal.invalid; postgres://svc:pw@db.internal.invalid:5432/m", []),
    ("@scan.route('/x') left-grid@1.30.0 version@2.1 at the end of a.line", []),
    ("call +1 617-555-0181 ext. 940 or (212) 555-0145, 030/23125646; +33 (0)1 99 00 12 31.", [("phone", "+1 617-555-0181 ext. 940"), ("phone", "(212) 555-0145"), ("phone", "030/23125646"), ("phone", "+33 (0)1 99 00 12 31")]),
    ("by phone (01 99 00 92 66) and ((303) 555-0139)", [("phone", "01 99 00 92 66"), ("phone", "(303) 555-0139")]),
    ("Ticket 212-5550-1234567. SHA 555-0134-a7, build 4155550199877, trace 900-12-34567-8, 10.2.3.4:80, 2031-03-14 10:15:00", []),
    ('a("955-13-8539"), "Steuer-ID", "00705182339", 07 535 540 460, 037278-Y274, 24390725-I, ZX3317492, QQ 57 14 96 D, QQ804578A', [("idnum", x) for x in ("955-13-8539", "00705182339", "07 535 540 460", "037278-Y274", "24390725-I", "ZX3317492", "QQ 57 14 96 D", "QQ804578A")]),
    ("Order QX-20311-7 and sku SK-0193-B fail.", []),
    ('ship_to = "161b Thistlewick Road, Apt 12, Little Sarn 45261"', [("address", "161b Thistlewick Road, Apt 12, Little Sarn 45261")]),
    ("went to Krähenberger Straße 63, 50309 Grünhafen twice", [("address", "Krähenberger Straße 63, 50309 Grünhafen")]),
    ("put 58 bis chemin d'Orvin, 27122 Bourg-l'Étang in the wrong zone", [("address", "58 bis chemin d'Orvin, 27122 Bourg-l'Étang")]),
    ("label: C/ de los Tejares 56, 3º, 15530 Arenal del Soto twice.", [("address", "C/ de los Tejares 56, 3º, 15530 Arenal del Soto")]),
    ("Unter den Eiben 55, 88667 Grünhafen", [("address", "Unter den Eiben 55, 88667 Grünhafen")]),
    ("Main Street parser. Lane 4 and Court 2 are closed. Moves 14 road_type rows. use a::{b, NodeStreet};", []),
]


@pytest.mark.parametrize(("text", "want"), LABELLED)
def test_labelled_lines(text, want):
    got = [(k, text[a:b]) for a, b, k in Detector(PEOPLE).spans(text)]
    assert got == want
    framed = f"first\r\n+{text}\n-{text}\nlast"
    assert [(k, framed[a:b]) for a, b, k in Detector(PEOPLE).spans(framed)] == want * 2


def test_binary_patches_are_no_text():
    text = "GIT binary patch\nliteral 9\nzKesdan +16175550181 a@b.test\n\ndiff --git a/x b/x\n+Kesdan"
    assert [(k, text[a:b]) for a, b, k in Detector(PEOPLE).spans(text)] == [("name", "Kesdan")]


# ---- surrogates ----


def test_surrogates_keep_form_and_stay_apart():
    s = Surrogates("k", NameModel(PEOPLE))
    items = [("phone", f"+1 617-555-{i:04d}") for i in range(300)] + [("idnum", f"9{i:02d}-44-1112") for i in range(100)] + [("email", f"{p.split()[0].lower()}{i}@mail.example") for i, p in enumerate(PEOPLE)] + [("name", p) for p in PEOPLE]
    new = s.of(items)
    assert len(set(new.values())) == len(items) and not set(new.values()) & {v for _, v in items}
    for (kind, old), made in new.items():
        if kind != "name":
            assert re.sub(r"\d", "0", re.sub("[a-z]", "a", made)) == re.sub(r"\d", "0", re.sub("[a-z]", "a", old))
    assert Surrogates("other", NameModel(PEOPLE)).of(items) != new and Surrogates("k", NameModel(PEOPLE)).of(items) == new


def test_surrogates_follow_a_person():
    s = Surrogates("k", NameModel(PEOPLE))
    new = s.of([("name", v) for v in ("Rivvik Holmvale", "Holmvale, Rivvik", "Rivvik", "RIVVIK HOLMVALE", "R. Holmvale")])
    given, family = new["name", "Rivvik Holmvale"].split()
    assert new["name", "Holmvale, Rivvik"] == f"{family}, {given}" and new["name", "Rivvik"] == given
    assert new["name", "RIVVIK HOLMVALE"] == f"{given} {family}".upper() and new["name", "R. Holmvale"] == f"{given[0]}. {family}"
    soft = s.of([("name", "Torira Stavquist")])["name", "Torira Stavquist"].split()[0]
    assert soft[-1] in "aeiou" and given[-1] not in "aeiou"


def test_surrogates_leave_nothing_as_it_was():
    s = Surrogates("k", NameModel(PEOPLE))
    items = [("name", n) for n in ("Иван Петров", "王伟", "Øø", "Γιώργος Παπαδόπουλος", "محمد", "Rivvik", "X")] + [("address", f"Am {i}") for i in range(10)]
    new = s.of(items)
    assert all(new[i] != i[1] for i in items) and len(set(new.values())) == len(items) and not set(new.values()) & {v for _, v in items}
    assert re.fullmatch("[А-Я][а-я]{3} [А-Я][а-я]{5}", new["name", "Иван Петров"]) and len(new["name", "王伟"]) == 2
    # ten addresses of one digit leave no permutation free
    assert all(re.fullmatch(r"\[ADDRESS-[0-9a-f]{20}\]", new[i]) for i in items[7:])


def test_one_surrogate_in_the_whole_corpus(spark):
    texts = [f"call +1 617-555-{i:04d} or {100 + i}-55-{i:04d}; mail kes.{i}@mail.example or ask Rivvik Holmvale, R. Holmvale" for i in range(60)]
    df = docs(spark, *texts, *texts[:7])
    got = privacy.personal_items(df, people_table(spark), "k").collect()
    by = {}
    for r in got:
        by.setdefault((r["kind"], r["value"]), set()).add(r["surrogate"])
    assert len(by) == 60 * 3 + 2 and all(len(v) == 1 for v in by.values())
    new = [next(iter(v)) for v in by.values()]
    assert len(set(new)) == len(new) and not set(new) & {v for _, v in by}
    masked = sorted(r["text"] for r in privacy.disguised(df, people_table(spark), "k").collect())
    assert len(masked) == 67 and not any("Holmvale" in t or "mail.example" in t for t in masked)
    assert len(set(masked)) == 60 and all(any(n in t for n in new) for t in masked)


def test_detection_has_no_reach():
    d = Detector(PEOPLE)
    found = lambda t: [(k, t[a:b]) for a, b, k in d.spans(t)]
    for n in (5, 63, 64, 250, 5000):
        assert found(f"see https://user:{'p' * n}@host.example/x") == []
        assert found(f"see {'p' * n}@host.example now") == [("email", f"{'p' * n}@host.example")]
        assert found(f"ssh {'-v ' * n}{'p' * n}@host.example") == []
    assert found("lives at 221B Baker Street, London") == [("address", "221B Baker Street, London")]
    assert found("call 0044 20 7946 0958 now") == [("phone", "0044 20 7946 0958")]
    assert found("пишите: почта@пример.рф") == [("email", "почта@пример.рф")]
    assert found('reviewer("Nobody Inparticular")') == [("name", "Nobody Inparticular")]
    assert found("INSERT INTO t VALUES (7, 'x', '58 bis chemin d'Orvin, 27122 Bourg'), (8, 'y', 'z');") == [("address", "58 bis chemin d'Orvin, 27122 Bourg")]


def people_table(spark, names=PEOPLE):
    return spark.createDataFrame([(i, n) for i, n in enumerate([*names, None])], "contributor_id bigint, full_name string")


def test_item_columns_and_texts(spark):
    text = "Hi Kesdan,\n call 030/23125646 or 030/23125646. -- Rivvik Holmvale\r\n"
    df = docs(spark, text, None, "", "  ", "nothing here").withColumn("kind", F.lit("clash"))
    df = df.unionByName(df.where("doc_id = 0"))
    assert sorted(tuple(r)[:3] for r in privacy.personal_items(df, people_table(spark), "k").collect()) == [(0, "name", "Kesdan"), (0, "name", "Rivvik Holmvale"), (0, "phone", "030/23125646")]
    clean = {r["doc_id"]: r["text"] for r in privacy.redacted(df, people_table(spark)).collect()}
    assert clean == {0: "Hi [NAME],\n call [PHONE] or [PHONE]. -- [NAME]\r\n", 1: None, 2: "", 3: "  ", 4: "nothing here"}
    masked = {r["doc_id"]: r["text"] for r in privacy.disguised(df, people_table(spark), "k").collect()}
    assert masked[4] == "nothing here" and "Kesdan" not in masked[0] and masked[0].endswith("\r\n")
    assert privacy.personal_items(df.where("false"), people_table(spark), "k").count() == 0
    assert [r["kind"] for r in privacy.personal_items(df, people_table(spark, []), "k").collect()] == ["phone"]


# ---- queries ----


def test_queries_run_on_stored_tables(spark, data):
    for name, query in queries.registry.queries.items():
        assert query(spark, data).count() > 0, name
    assert queries.registry.queries["p9_found"](spark, data).dtypes == [("doc_id", "bigint"), ("kind", "string"), ("value", "string")]
    assert queries.registry.queries["p7_ids"](spark, data).dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]


def test_every_capacity_binds(spark, data):
    filled = packing.fill(queries.registry.queries["p8_bounded"](spark, data)).collect()
    assert max(r["n_pieces"] for r in filled) == 4 and all(r["n_tokens"] <= 2048 and r["attention_cost"] <= 2048 * 512 for r in filled)
    assert any(r["n_pieces"] == 4 and r["unused"] > 100 for r in filled) and any(r["attention_cost"] > 2048 * 512 * 0.99 for r in filled)
    tokens_in = queries.registry.queries["p7_counts"](spark, data).groupBy().sum("n_tokens").head()[0]
    assert sum(r["n_tokens"] for r in filled) == tokens_in


def test_no_item_is_left_in_redacted_texts(spark, data):
    """What is found once is gone from the redacted text."""
    clean = queries.registry.queries["p9_redacted"](spark, data)
    again = privacy.personal_items(clean, spark.read.parquet(f"{data}/contributors.parquet"), "k")
    assert again.count() == 0
