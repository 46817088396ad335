import collections
import os

import numpy as np
import pytest

from threadloom.llm import bpe, contamination, language, pii

PERSONAL = [
    ("Write to me at <awhitulski63@example.net> when it is done.", {"email"}), ("contact=samuel+zozezi (at) post dot invalid Why", {"email"}),
    ("The account uses nadia.x @ mail.example as its login.", {"email"}), ("It mentioned @lerofu and #quiet_7797 in one breath.", set()),
    ("The file export_3740_v2@final was empty.", set()), ("Call me on +49 30 23125 149 if the app goes quiet.", {"phone"}),
    ("Texted 617 - 555 - 0168 twice", {"phone"}), ("my number is +12125550128", {"phone"}), ("(cell 3 0 3 5 5 5 0 1 7 5, work hours only)", {"phone"}),
    ("Ruf mich unter 030/23125138 an", {"phone"}), ("We counted 5581,281,287 steps on the road to Fedoto.", set()),
    ("The build number was 4.2.5393.12, not the newer one.", set()), ("Version 8.3.0 came on 18/09/2024, 1970 downloads.", set()),
    ("Order 9169-51 of Dashagu shipped on 2024-08-17.", set()), ("SSN 945-94-4553, in case the form asks.", {"id_number"}),
    ("It stored 990 35 9405 as my social and I do not like that. my number is +12125550128", {"id_number", "phone"}),
    ("identity card no. ZQ 29 21 55 X was in the photo I sent.", {"id_number"}), ("Meine Ausweisnummer ist ZZ4353264 laut Formular.", {"id_number"}),
    ("mail, phone and passport are all just words", set()), ("I live at 190B Birchwater Road, Webesa, second floor.", {"street_address"}),
    ("The parcel went to 340 sable hill ave again.", {"street_address"}), ("Bitte an Kupferweg 41a, 40793 Tutrifa schicken.", {"street_address"}),
    ("Tell Elif L. Morroakis that I am sorry.", {"name"}), ("Sincerely, de Haskdottir, Soraya.", {"name"}), ("the landlord, clara de ulveretti, has the spare key.", {"name"}),
    ("my ex (KWAME JARROULSKI) read all of this", {"name"}), ("Dario called again and hung up before Zulibro could.", set()),
    ("DARIO CALLED AGAIN", set()), ("The bot called Trokoli never questioned it. Maybe Titrabro.", set()), ("[NAME] and [EMAIL]", set()), ("", set()), (None, set()),
]


@pytest.mark.parametrize("text,kinds", PERSONAL)
def test_personal_items(text, kinds):
    assert set(pii.redact(text)[1]) == kinds


UNLISTED = [
    ("Tell Ottoline Brackwater that I am sorry.", "Tell [NAME] that I am sorry."), ("I asked THORVALD DE WINCKHAM about it", "I asked [NAME] about it"),
    ("my neighbour, Eudora van Plessen, has the key", "my neighbour, [NAME], has the key"), ("Sincerely, Brackwater, Ottoline.", "Sincerely, [NAME]."),
    ("Dr. Ottoline P. Brackwater said so", "Dr. [NAME] said so"), ("Frag bitte Thorvald Winckham, falls", "Frag bitte [NAME], falls"), ("Me llamo Eudora Plessen.", "Me llamo [NAME]."),
]


@pytest.mark.parametrize("text,clean", UNLISTED)
def test_names_off_the_list(text, clean):
    assert not set("ottoline thorvald eudora".split()) & set(pii.GIVEN)
    assert pii.redact(text)[0] == clean


@pytest.mark.parametrize("text", ["I asked Ottoline about it", "Tell Frau Winckham", "My Flatmate Repeated Back Why I Stopped", "eINE fRAU AUS DEM cHOR BESCHRIEB", "tell Customer Service", "TELL THEM EVERYTHING NOW"])
def test_no_names_at_cues(text):
    assert pii.redact(text) == (text, [])


def test_redaction_keeps_the_rest(spark):
    text = "Call me on 415.555.0150, or ask Hugo Fennova at 12 Minnow St., Apt 3."
    assert pii.redact(text)[0] == "Call me on [PHONE], or ask [NAME] at [STREET_ADDRESS]."
    df = spark.createDataFrame([(1, text, "k"), (1, text, "k"), (2, None, "k"), (3, "İ" * 50_000 + " a@b.org", "k")], "row_id bigint, content string, kind string")
    assert sorted((r.row_id, r.kind) for r in pii.found(df).collect()) == [(1, "name")] * 2 + [(1, "phone")] * 2 + [(1, "street_address")] * 2 + [(3, "email")]
    assert [r.content for r in pii.redacted(df).collect()][2] is None and pii.found(df.limit(0)).count() == 0


def test_names_learned_from_the_corpus(spark):
    """Full names with given names of no list, at cues in some rows and without any cue in others: recall and precision."""
    rng = np.random.default_rng(8)
    made = ["".join(rng.choice(list("bdfgklmnprstvz")) + rng.choice(list("aeiou")) for _ in range(3)) + rng.choice(list("nlrs")) for _ in range(160)]
    given, family = [w.capitalize() for w in made[:12]], [w.capitalize() for w in made[12:]]
    assert not {g.lower() for g in given} & set(pii.GIVEN)
    full = lambda: f"{rng.choice(given)} {rng.choice(family)}"
    cued = [f"Yesterday I met {full()} on the bridge." for _ in range(150)]
    bare = [f"Then {full()} took the last boat and the rain began." for _ in range(150)]
    none = [f"Then {rng.choice(given)} took the last boat to {rng.choice(family)} Bay, and the rain began." if k % 2 else "The Old Harbour Inn was shut on Monday." for k in range(150)]
    texts = cued + bare + none
    df = spark.createDataFrame(list(enumerate(texts)), "row_id bigint, content string")
    names = pii.learned(df)
    assert set(names) == {g.lower() for g in given}
    got = {r.row_id for r in pii.found(df).where("kind = 'name'").collect()}
    right = set(range(300))
    assert len(got & right) >= 0.97 * 300 and len(got & right) >= 0.95 * len(got)
    assert {r.row_id for r in pii.found(df, names=()).where("kind = 'name'").collect()} <= set(range(150))
    assert pii.learned(df.limit(0)) == ()


TEXTS = ["", None, "Hello world", "  two  spaces\n\n\n", "don't we'll I'M", "café é 👩‍💻 你好 مرحبا", "<|endoftext|> </s>", "a" * 3000, "x=[i**2 for i in range(10)]\t\t", "﻿\xa0—", "12345 0x1f"]


@pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="no vocabulary here")
def test_ids_equal_library_and_round_trip(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.VOCABULARY)
    t.encode_special_tokens = True
    df = spark.createDataFrame([(i, x, [1]) for i, x in enumerate(TEXTS)], "doc_id bigint, text string, ids array<int>")
    got = {r.doc_id: r.ids for r in bpe.encoded(df).collect()}
    assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(TEXTS)}
    back = {r.doc_id: r.text for r in bpe.decoded(bpe.encoded(df)).collect()}
    assert back == {i: x or "" for i, x in enumerate(TEXTS)}
    assert bpe.encoded(df.limit(0)).count() == 0


def brute(docs, items, run=12):
    out = set()
    for d, text in docs:
        w = contamination.words(text)
        there = {tuple(w[i : i + run]) for i in range(len(w) - run + 1)}
        for k, t in items:
            v = contamination.words(t)
            if any(tuple(v[i : i + run]) in there for i in range(len(v) - run + 1)):
                out.add((d, k))
    return out


def test_leaks_equal_brute_force(spark):
    import random

    rng = random.Random(2)
    vocab = [f"w{k}" for k in range(40)] + ["the", "of", "and"] * 10
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.randint(5, 60)))) for k in range(60)] + [(60, None), (61, ""), (62, "ä ß " * 8)]
    items.append((63, items[0][1]))
    docs = []
    for d in range(150):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 120))]
        _, t = rng.choice(items[:60])
        v = t.split()
        n = rng.randint(8, 16)
        at = rng.randint(0, max(0, len(v) - n))
        docs.append((d, " ".join(w + [", ".join(v[at : at + n]).upper()] + w)))
    docs += [(900, None), (901, ""), (902, "Ä SS \n> " * 40), (903, items[3][1] + " x" * 100_000)]
    got = contamination.leaked(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute(docs, items) and len(got) == len(brute(docs, items))


@pytest.mark.parametrize("run", [12, 24, 25, 26, 40])
def test_leaks_of_any_run_and_of_one_repeated_word(run):
    item = [f"w{k}" for k in range(60)]
    index = contamination.Index([(1, item), (2, ["echo"] * 60)], run)
    for at in range(0, 60 - run, 7):
        assert index.leaks(["x"] * (at * 3) + item[at : at + run] + ["y"] * 9) == {1: 1}
        assert index.leaks(["x"] * at + item[at : at + run - 1] + ["y"] * 50) == {}
    assert index.leaks(["echo"] * run) == {2: 1} and index.leaks(["echo"] * (run - 1)) == {}


def test_answers_beside_leaks(spark):
    hits = spark.createDataFrame([(1, 7, 3), (1, 7, 3), (2, 8, 1), (2, 9, 1)], "doc_id bigint, item_id bigint, runs int")
    documents = spark.createDataFrame([(1, "So: Yes, the blue FERRY."), (2, "nothing"), (3, None)], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, "blue ferry"), (8, "yes"), (9, None)], "item_id bigint, answer string")
    assert {tuple(r) for r in contamination.answered(hits, documents, items).collect()} == {(1, 7, 3, True), (2, 8, 1, False), (2, 9, 1, None)}


def test_leaks_of_several_item_blocks(spark, monkeypatch):
    monkeypatch.setattr(contamination, "BLOCK_ITEMS", 1)
    text = " ".join(f"t{k}" for k in range(20))
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, text), (2, text)], "item_id bigint, text string")
    assert {r.item_id for r in contamination.leaked(docs, items).collect()} == {1, 2}
    assert contamination.leaked(docs, items.limit(0)).count() == 0


SENTENCES = {
    "en": "The old house stands near the river. We never asked why the light was on.", "de": "Das alte Haus steht am Fluss. Wir fragten nie, warum das Licht an war.",
    "es": "La casa vieja está cerca del río. Nunca preguntamos por qué la luz estaba encendida.", "ru": "Старый дом стоит у реки. Мы никогда не спрашивали, почему горит свет.",
}


def test_languages(spark):
    rows = [(i, SENTENCES[c], c) for i, c in enumerate(list(SENTENCES) * 12)]
    rows += [(100, SENTENCES["en"], "de"), (101, SENTENCES["en"] + "\n" + SENTENCES["ru"], "en"), (102, SENTENCES["de"], None), (103, SENTENCES["es"], "??"),
             (104, SENTENCES["es"], "Spanish"), (105, SENTENCES["de"], "de-AT"), (106, None, None), (107, "", "xx"), (108, "🙂 404", None), (109, "你好 مرحبا", None)]
    df = spark.createDataFrame([(*r, "e") for r in rows], "doc_id bigint, text string, lang string, language string")
    got = {(r.doc_id, r.language) for r in language.mislabelled(df).collect()}
    assert got == {(100, "en"), (101, "en"), (101, "ru"), (102, "de"), (103, "es")}
    seg = [(r.position, r.language) for r in language.segments(df.where("doc_id in (101, 0, 3)").orderBy("doc_id")).where("doc_id = 101").orderBy("position").collect()]
    assert seg[-1][1] == "ru"
    assert language.mislabelled(df.limit(0)).count() == 0


def test_every_worded_document_and_stretch_has_a_language(spark):
    en, ru = "the old house stands near the river", "старый дом стоит у реки"
    rows = [(i, SENTENCES[c], c) for i, c in enumerate(list(SENTENCES) * 12)]
    rows += [(100, f"{en} {ru} and {en}.", None), (101, "House.", None), (102, f"stands near the river {ru[:-5]}.", None), (103, "你好 мир", None), (104, "你好", None), (105, "", None), (106, "404", None), (107, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {}
    for r in language.segments(df).orderBy("doc_id", "position").collect():
        got.setdefault(r.doc_id, []).append((r.words, r.language))
        assert 0 <= r.confidence <= 1 and r.position == len(got[r.doc_id]) - 1
    assert got[100] == [(7, "en"), (5, "ru"), (8, "en")] and got[102] == [(4, "en"), (4, "ru")] and len(got[101]) == 1 and got[104] == [(1, "und")]
    assert set(got) == set(range(48)) | {100, 101, 102, 103, 104}
    whole = {r.doc_id: r for r in language.documents_languages(df).collect()}
    assert set(whole) == set(got) and whole[100].language == "en" and whole[101].confidence < whole[0].confidence and whole[104].confidence == 0


def test_labels():
    assert language.named("en-US") == {"en"} and language.named(" DEU ") == {"de"} and language.named("und") is None and language.named("en, de") == {"en", "de"}


def test_held_out_language_accuracy(data):
    import pandas as pd

    d = pd.read_parquet(data.replace("0.001", "0.01") + "/documents.parquet").dropna(subset=["text", "lang"])
    rows = [(t, next(iter(language.named(s)))) for t, s in zip(d.text, d.lang) if t.strip() and language.named(s) and len(language.named(s)) == 1]
    rows = [r for r in rows if r[1] in language.LANGUAGES]
    model = language.fit(rows[: len(rows) // 2])
    held = [(language._languages(model, t), c) for t, c in rows[len(rows) // 2 :]]
    held = [(set(s), c) for s, c in held if s]
    assert sum(c in s for s, c in held) / len(held) > 0.9  # labels themselves are wrong for some per cent


def test_batched_viterbi_equals_every_path():
    """Labels of texts of many lengths, read together and alone, score as the best of all paths."""
    import itertools

    rng = np.random.default_rng(4)
    model = language.Model({i: collections.Counter() for i in range(len(language.LANGUAGES))})
    size = np.array([0, 1, 2, 3, 4, 4, 3, 2, 1, 0, 4, 3, 2, 1, 4, 4, 3, 4, 2, 4, 4])
    emitted = -4 * rng.random((size.sum(), len(language.LANGUAGES))) ** 2
    emitted[:, 3:] = -9.0
    opens = rng.random(size.sum()) < 0.4
    got, at = model.labels(emitted, opens, size), 0
    for n in size:
        e, o = emitted[at : at + n], opens[at : at + n]

        def value(path):
            moves = sum((language.SWITCH_BETWEEN if o[k] else language.SWITCH_WITHIN) for k in range(1, n) if path[k] != path[k - 1])
            return sum(e[k][s] for k, s in enumerate(path)) - moves

        best = max(map(value, itertools.product(range(3), repeat=int(n))))
        assert abs(value(got[at : at + n]) - best) < 1e-9
        if n:
            assert (model.labels(e, o, np.array([n])) == got[at : at + n]).all()
        at += n


def test_stretches_can_be_located(spark):
    text = "Der Hund läuft heute nicht mehr durch den Garten. The dog is running through the garden now and it is happy.\nok"
    df = spark.createDataFrame([(k, "The dog is running through the garden now and it is happy" if k % 2 else "Der Hund läuft heute nicht mehr durch den Garten", "en" if k % 2 else "de") for k in range(40)] + [(99, text, None), (100, None, None), (101, "x" * 30_000 + " \u65e5\u672c", "en")], "doc_id bigint, text string, lang string")
    got = language.segments(df).where("doc_id = 99").orderBy("position").collect()
    assert [r.language for r in got][:2] == ["de", "en"] and text[got[0].begins : got[0].ends] == text[: text.index(".")]
    assert text[got[1].begins :].startswith("The dog") and sum(r.words for r in got) == 22


def test_redacted_files(spark, tmp_path):
    (tmp_path / "in/a").mkdir(parents=True)
    (tmp_path / "in/a/x.txt").write_text("Write to a.b@mail.example\nor call +1 212 555 0128.")
    (tmp_path / "in/y.txt").write_text("nothing here")
    (tmp_path / "in/z.bin").write_text("c@d.example")
    counts = {r.kind: r.texts for r in pii.redact_files(spark, str(tmp_path / "in"), str(tmp_path / "out")).collect()}
    got = sorted(r.content for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert counts == {"email": 1, "phone": 1} and got == ["Write to [EMAIL]\nor call [PHONE].", "nothing here"]
