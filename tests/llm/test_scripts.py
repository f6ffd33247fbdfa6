"""Sentences and languages of scripts that the tables do not hold."""

import pytest

from gatewarden.llm import languages, sentences

TWO = {
    "Armenian": "Սա առաջին նախադասությունն է։ Սա երկրորդն է։",
    "Ethiopic": "ይህ የመጀመሪያው ነው። ይህ ሁለተኛው ነው።",
    "Burmese": "ဒါက ပထမ ဖြစ်တယ်။ ဒါက ဒုတိယ ဖြစ်တယ်။",
    "Khmer": "នេះជាប្រយោគទីមួយ។ នេះជាទីពីរ។",
    "Tibetan": "འདི་དང་པོ་ཡིན། འདི་གཉིས་པ་ཡིན།",
    "Bengali": "এটি প্রথম বাক্য। এটি দ্বিতীয়।",
    "Urdu": "یہ پہلا جملہ ہے۔ یہ دوسرا ہے۔",
    "Mongolian": "ᠡᠨᠡ ᠨᠢᠭᠡ᠃ ᠡᠨᠡ ᠬᠣᠶᠠᠷ᠃",
    "Greek": "Αυτό είναι ένα. Αυτό είναι δύο.",
    "Georgian": "ეს ერთია. ეს ორია.",
}


@pytest.mark.parametrize("script", TWO)
def test_two_sentences_in_any_script(script):
    text = TWO[script]
    got = [text[a:b] for a, b in sentences.boundaries(text)]
    assert len(got) == 2 and " ".join(got) == text


def test_stops_have_the_property():
    assert {*"։።။།។।॥۔؟。！？.!?…"} <= sentences.TERMINATORS and not {*",;:-a1\"'"} & sentences.TERMINATORS


@pytest.mark.parametrize("code, text", [
    ("uk", "Ми їдемо до міста і купуємо хліб."), ("ru", "Мы едем в город и покупаем хлеб, это рядом."), ("fa", "ما امروز به شهر می‌رویم و نان می‌خریم."),
    ("ar", "نذهب اليوم إلى المدينة ونشتري الخبز في السوق."), ("ko", "우리는 오늘 도시에 가서 빵을 산다."), ("el", "Πηγαίνουμε στην πόλη και αγοράζουμε ψωμί."), ("he", "אנחנו הולכים לעיר וקונים לחם."),
])
def test_languages_of_other_scripts(code, text):
    model = languages.LanguageModel().fit([("the cat sat on the mat and it was warm", "en"), ("le chat est sur le tapis et il fait chaud", "fr")] * 30)
    assert model.detect([text])[0][0] == code
