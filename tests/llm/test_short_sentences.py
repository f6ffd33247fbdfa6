"""Short whole sentences and sentences of unseen words count for their language."""

import random

import pytest

from gatewarden.llm import languages

EN = "the people of the town have been asked what they think about this plan and whether it will be good for them"
DE = "die leute in der stadt haben gefragt was sie über diesen plan denken und ob er gut für sie sein wird"


@pytest.fixture(scope="module")
def model():
    r = random.Random(5)
    rows = []
    for code, s in (("en", EN), ("de", DE)):
        for _ in range(30):
            i = r.randrange(8)
            rows.append((" ".join(s.split()[i : i + 12]).capitalize() + ".", code))
    return languages.LanguageModel().fit(rows)


@pytest.mark.parametrize("code, short", [("ru", "Спасибо, всё работает."), ("ar", "شكرا جزيلا لك."), ("th", "ขอบคุณมากครับ"), ("hi", "यह काम करता है।"), ("zh", "谢谢你们。"), ("ja", "ありがとう。")])
def test_short_sentence_in_another_script(model, code, short):
    assert set(model.detect([f"{EN.capitalize()}. {short}"])[0][2]) == {"en", code}


def test_address_inside_another_script(model):
    assert model.detect(["Отправь черновик на bo-wmoe681 [at] town [dot] people, спасибо."])[0][0] == "ru"


def test_unseen_words_tell_by_their_grams(model):
    s = "Gefragte stadtleute denkend diesen."
    assert not any(w in model.words for w in ("gefragte", "stadtleute", "denkend"))
    assert [code for code, _, _ in model.sentences([s])] == ["de"]
    assert model.sentences(["Mardo vixor."])[0][0] is None
