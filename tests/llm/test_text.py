"""Operators on texts against brute force, exact round trips and held-out accuracy."""

import random

import pytest
from pyspark.sql import functions as F

from gatewarden.llm import bitwise, bpe, languages, leaks, sentences
from gatewarden.llm.fold import tokens

RECORD = "origin string, record_id string, text string, label string, source string, publisher_id string"


@pytest.fixture(scope="module")
def encoder():
    return bpe.PrefixEncoder(bpe.read_ranks())


def _random_text(r):
    return "".join(r.choice(["a", "the ", " café", "1", "23 ", "\n", "  ", "日本", "ผม", "'s", "🙂", "ZZ", "-", "e", "​"]) for _ in range(r.randrange(60)))


def test_bpe_equals_the_public_encoder(encoder):
    import tiktoken

    plain = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})
    r = random.Random(1)
    for text in [_random_text(r) for _ in range(300)] + ["<|endoftext|>", "a" * 5000, " " * 300, "ab" * 2000]:
        assert encoder.encode(text) == plain.encode_ordinary(text)
        assert plain.decode(encoder.encode(text)) == text
    assert encoder.encode("") == encoder.encode(None) == []


def test_edits_keep_the_encoding(encoder):
    r = random.Random(2)
    for _ in range(60):
        text = bpe.EditableText(encoder, _random_text(r))
        for _ in range(4):
            i = r.randrange(len(text.text) + 1)
            j = min(len(text.text), i + r.randrange(4))
            text.replace(i, j, _random_text(r)[:5])
            assert text.ids() == encoder.encode(text.text)
        text.append(" more")
        assert text.ids() == encoder.encode(text.text)


def test_bpe_table(spark):
    df = spark.createDataFrame([(1, "hello world", 5), (2, None, 5), (3, "", 5), (1, "hello world", 6)], "doc_id bigint, text string, ids int")
    got = sorted((r.doc_id, r.ids) for r in bpe.encode_corpus(df, "doc_id", "text").collect())
    assert got == [(1, [31373, 995]), (1, [31373, 995]), (2, []), (3, [])]
    assert bpe.encode_corpus(df.where("doc_id = 9"), "doc_id", "text").count() == 0


@pytest.mark.parametrize(
    "parts",
    [
        ["The U.S. feed lists approx. 64 items, e.g. a kettle, and costs $4.8 per batch.", "Wait... did it move?!", "Yes."],
        ["‘Stop. Check again.’ is what he says.", "See https://a.example/v1.2/index.html for notes.", "Open a.Config.yaml vs. rules.v2.json now."],
        ["„Ist das gut? Wohl kaum!“, schrieb jemand.", "Am 3. Oktober war es so, z. B. 34,39 Punkte."],
        ["El Sr. director de X, S. A., valoró 5,2 puntos.", "¿Qué?", "¡Por fin!"],
        ["Фирма X, т. е. бывшая Y, и т. д. по списку.", "Ну... кто это?"],
        ["It opens at 9 a.m.", "Only then we go, etc.", "Done.🎉", "Next (see Fig. 3. It is short.) one."],
        ["“Is it safe? I doubt it!” wrote a reader.", "He promised “no more.”", "Fine."],
        ["Moro na rua do Moinho, 94, ap. 3, Vila Serrana.", "Lena Q., Lindenfeldstr. 174, 02011 Neuhavel, tel. +49 30 23125 490.", "Я живу на ул. Мельничная, д. 8, кв. 3, г. Старогорск.", "Дальше."],
        ["क्र. 57 को 28.21 अंक मिले।", "अगला वाक्य।"],
    ],
)
def test_sentences(parts):
    text = " ".join(parts)
    assert [text[a:b] for a, b in sentences.boundaries(text)] == parts


def test_sentences_without_spaces():
    text = "评分是34.31分（见第94节。说明很短。），已经确认！“好用吗？我不信！”读者这样写给X。最后"
    assert [text[a:b] for a, b in sentences.boundaries(text)] == ["评分是34.31分（见第94节。说明很短。），已经确认！", "“好用吗？我不信！”读者这样写给X。", "最后"]
    text = "ราคาดีมาก รุ่น 3.45 ของ Abc ใหม่"
    assert [text[a:b] for a, b in sentences.boundaries(text)] == ["ราคาดีมาก", "รุ่น 3.45 ของ Abc ใหม่"]


def test_sentences_cover_all_text():
    r = random.Random(3)
    for _ in range(200):
        text = "".join(r.choice(["A b.", " ", "\n", "\n\n", "c! ", "。", "“", "”", "(", ")", "🙂", "ก", "x.Y ", "3.", "\r\n", "..."]) for _ in range(r.randrange(40)))
        spans = list(sentences.boundaries(text))
        assert all(a < b and text[a:b] == text[a:b].strip() for a, b in spans)
        assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
        assert "".join(text.split()) == "".join("".join(text[a:b].split()) for a, b in spans)


def test_sentence_table(spark):
    df = spark.createDataFrame([(1, "All is well. Next one."), (2, None), (3, " \n "), (1, "One. Two.")], "doc_id bigint, text string")
    assert sentences.sentence_table(df, "doc_id", "text").count() == 4


def test_edit_distance_and_lcs_against_tables():
    r = random.Random(4)
    for _ in range(300):
        a, b = ([r.choice("abc") for _ in range(r.randint(1, 12))] for _ in range(2))
        row = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        lcs = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            row[i][0] = i
            for j in range(1, len(b) + 1):
                row[i][j] = min(row[i - 1][j] + 1, row[i][j - 1] + 1, row[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                lcs[i][j] = lcs[i - 1][j - 1] + 1 if a[i - 1] == b[j - 1] else max(lcs[i - 1][j], lcs[i][j - 1])
        assert bitwise.best_match(bitwise.masks(a), len(a), b)[0] == min(row[-1])
        assert bitwise.lcs_length(a, b) == lcs[-1][-1]


ITEMS = [
    (1, "Read the text and choose. The ferryman of Orvane owed 64 loaves to the people who slept in the barn. A keeper near Illex counted 357 ships and boats during the long frost of Zorsia."),
    (2, "Read the text and choose. The bridge over the river Krana was rebuilt after the harvest of Yorpid when its 13 arches had sunk. The choir of Vadno sang 48 songs in a box."),
    (3, "Read the text and choose. The bells cast at Kelka weigh eleven tons and the frost of Mart cracked the oldest."),
    (4, "养蜂人把58个蜂箱从Folzia搬到Calwyn，因为三叶草已经枯死。Telres双重洪水结束时，Telex的船夫欠下睡在旧谷仓的人681个面包。"),
    (5, None),
]


def test_leaks(spark):
    docs = [
        (1, "Hello. THE FERRYMAN of Orvane owed 64 loaves to the folk who slept in barn. More text here."),  # half, changed
        (2, "The ferryman of Belmor owed 12 loaves to the people who slept in the barn."),  # other names
        (3, "Read the text and choose. Nothing else."), (4, None), (5, ""),
        (6, "x Ａ keeper near Illex counted ３５７ ships and boats, during the long frost of Zorsia! " + "word " * 3000),
        (7, "前面。养蜂人把58个蜂箱从Fol的zia搬到Calwyn，因为三叶已经枯死。后面。Telres双重洪水结束时，Telex船夫欠下睡在旧谷仓的人681个面包。"),
        (7, "The bells cast at Kelka weigh eleven tons and the frost of Mart cracked the oldest."),
    ]
    got = leaks.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), "doc_id", "text", spark.createDataFrame(ITEMS, "item_id bigint, text string"), "item_id", "text", block=3)
    assert {tuple(r) for r in got.collect()} == {(1, 1), (6, 1), (7, 4), (7, 3)}


def test_no_items_no_leaks(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    assert leaks.find_leaks(docs, "doc_id", "text", spark.createDataFrame([], "item_id bigint, text string"), "item_id", "text").count() == 0


SAMPLES = {
    "en": "the people of the town have been asked what they think about this plan and whether it will be good for them",
    "es": "la gente de la ciudad ha preguntado qué piensa sobre este plan y si será bueno para todos ellos",
    "fr": "les gens de la ville ont demandé ce que nous pensons de ce plan et si cela sera bon pour eux",
    "de": "die leute in der stadt haben gefragt was sie über diesen plan denken und ob er gut für sie sein wird",
    "pt": "as pessoas da cidade perguntaram o que eles acham sobre este plano e se ele será bom para todos",
}


@pytest.fixture(scope="module")
def model():
    r = random.Random(5)
    rows = []
    for code, s in SAMPLES.items():
        for _ in range(30):
            w = s.split()
            i = r.randrange(8)
            rows.append((" ".join(w[i : i + 12]).capitalize() + ".", code if r.random() > 0.1 else "fr"))
    return languages.LanguageModel().fit(rows)


def test_labels():
    want = {"English": "en", " en-US ": "en", "ENG": "en", "zh_CN": "zh", "deutsch": "de", "und": None, "unknown": None, "": None, None: None, "n/a": None, "Italian": "it"}
    assert {k: languages.label_code(k) for k in want} == want


def test_languages(model):
    for code, s in SAMPLES.items():
        assert model.detect([s.capitalize() + "."])[0][0] == code
    both = SAMPLES["en"].capitalize() + ". " + SAMPLES["de"].capitalize() + "."
    code, conf, firm = model.detect([both])[0]
    assert set(firm) == {"en", "de"} and conf < 1
    assert [s[2] for s in model.segments([both])[0]] == ["en", "de"]
    assert model.detect(["Кто-то написал длинное письмо."])[0][0] == "ru"
    assert model.detect(["用一句话总结新手父母的看法。", "レシピについてまとめてください。", "", "12 34"])[0][0] == "zh"
    assert [x[0] for x in model.detect(["レシピについてまとめてください。", "", "12 34"])] == ["ja", None, None]
    assert languages.tokens("Keywords: Abc, Def, Ghi, Jkl.")[0] == []


def test_language_cases(spark, model):
    rows = [
        ("request", "a", SAMPLES["en"].capitalize() + ".", "English", None, None), ("request", "b", SAMPLES["en"].capitalize() + ".", "fr", None, None), ("request", "b", SAMPLES["en"].capitalize() + ".", "fr", None, None),
        ("document", "1", SAMPLES["de"].capitalize() + ".", None, "s", "p"), ("document", "2", "short", None, "s", "p"), ("document", "3", " ", None, "s", "p"),
    ]
    got = languages.find_cases(spark.createDataFrame(rows, RECORD), model)
    assert sorted(map(tuple, got.collect())) == [("document", "1", "de"), ("request", "b", "en")]
    assert languages.find_cases(spark.createDataFrame([], RECORD), model).count() == 0
    assert languages.record_table(spark.createDataFrame(rows, RECORD), model).count() == 5


def test_folding():
    assert tokens("Ｃafé​, DÉJÀ-vu 12 日本x") == ["cafe", "deja", "vu", "12", "日", "本", "x"]
    assert tokens("तुलना कीजिए, ज़िक्र") == ["तुलना", "कीजिए", "ज़िक्र"]


def test_bounded_sample(spark):
    from gatewarden.llm.records import bounded_sample

    df = spark.range(5000).select(F.col("id").cast("string").alias("t"))
    a = [r.t for r in bounded_sample(df, 100, "t")]
    assert len(a) == 100 and a == [r.t for r in bounded_sample(df.repartition(7), 100, "t")]
    assert [r.t for r in bounded_sample(df, 100, "t", about=9000)] == a
    assert len(bounded_sample(df.limit(10), 100, "t")) == 10 and bounded_sample(df.limit(0), 100, "t") == []
