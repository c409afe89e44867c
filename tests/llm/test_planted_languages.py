"""Planted cases with known truth: foreign lines, bylines of invented names, languages without a model, honest pages."""

import random

import pytest

from corvane.llm import langid, models, stuffing, words
from corvane.llm.queries import p2_found

OTHERS = {
    "ru": "Городской совет отложил строительство моста до весны, потому что рабочих рук не хватало. Жители района недовольны решением и требуют ответа от властей города. Мэр сказал, что в следующем году строительство начнётся в апреле и закончится в сентябре, если погода позволит.\nНа встрече в школе жители говорили, что мост нужен детям и старикам. Они предложили собрать деньги и начать работу в мае, но совет сказал, что в бюджете нет денег на проект.",
    "pl": "Rada miasta odłożyła budowę mostu do wiosny, ponieważ brakowało rąk do pracy. Mieszkańcy dzielnicy są niezadowoleni z tej decyzji i domagają się odpowiedzi od władz miasta. Burmistrz powiedział, że w przyszłym roku budowa zacznie się w kwietniu i skończy się w sierpniu, jeśli pogoda pozwoli.\nNa spotkaniu w szkole mieszkańcy mówili, że most jest potrzebny dzieciom i starszym. Zaproponowali, że w maju się zaczną prace, ale rada powiedziała, że w budżecie nie ma na to środków w tym roku.",
    "zh": "市议会将桥梁的建设推迟到春天，因为缺乏人手。该地区的居民对这一决定感到不满，并要求市政府作出答复。市长说，如果天气允许，明年四月开始施工，九月完工。\n在学校的会议上，居民们说，孩子和老人需要这座桥，他们建议筹集资金，五月开始工作，但是议会说，预算中没有这个项目的资金。",
}
NOISE = "asdkjh qwezxc poiuzt lkjhgf mnbvcx qazwsx edcrfv tgbyhn ujmikl plokij uhbygv tfcrdx eszwaq qwlkez"
BYLINES = {"en": "By {}, staff writer", "de": "Von {}, Redaktion", "nl": "Door {}, redactie", "fr": "Par {}, de la rédaction", "es": "Por {}, de la redacción", "pt": "Por {}, da redação"}


@pytest.fixture(scope="module")
def labelled(spark, small):
    return [(r["lang"], r["text"]) for r in spark.read.parquet(f"{small}/lang_samples.parquet").collect()]


def _name(rng):
    return " ".join("".join(rng.choices(["tor", "zel", "mor", "quin", "la", "bra", "ven", "dor", "ka", "sul"], k=3)).title() for _ in range(2))


def test_languages_without_a_model_give_no_row(labelled):
    scorer = models.Scorer(models.fit(labelled))
    for text in (*OTHERS.values(), NOISE):
        assert langid.judge([text], scorer)[0][0] is None
    real = "The committee voted late on Tuesday to reject the proposal, saying the plan would have cost taxpayers far more than expected."
    assert langid.judge([real], scorer)[0][0] == "en"
    mixed = f"{real}\n{OTHERS['pl'].splitlines()[0]}\n{NOISE}\n{real}"
    assert langid.judge([mixed], scorer)[0][3] == []


def test_planted_lines_and_bylines(spark, labelled, small):
    rng = random.Random(3)
    long = {x: sorted({t for lang, t in labelled if lang == x and len(t) > 150}) for x in BYLINES}
    truth, docs = set(), []
    for i in range(600):
        main, other = rng.sample(sorted(BYLINES), 2)
        lines = rng.sample(long[main], 3)
        of = rng.choice([main, main, other])
        lines.insert(rng.randrange(4), BYLINES[of].format(_name(rng)))
        if rng.random() < 0.3:
            lines.insert(rng.randrange(5), rng.choice(long[other]))
        label = rng.choice([main, main.upper(), None, other])
        by_lang = {x: sum(len("".join(models.LETTERS.findall(line))) for line in lines if line in long[x]) for x in (main, other)}
        for no, line in enumerate(lines, 1):
            lang = of if line not in long[main] and line not in long[other] else main if line in long[main] else other
            if lang != main and len("".join(models.LETTERS.findall(line))) >= 25:
                truth.add((i, no, lang))
        assert by_lang[main] > by_lang[other]
        if label is None or label == other:
            truth.add((i, 0, main))
        docs.append((i, "\n".join(lines), label))
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    samples = spark.createDataFrame(labelled, "lang string, text string")
    got = langid.languages_of(df, samples)
    found = {(r[0], r[1], r[2]) for r in got.where("line_no > 0 OR wrong").select("doc_id", "line_no", "lang").collect()}
    assert len(found & truth) >= 0.97 * len(truth)
    assert len(found & truth) >= 0.97 * len(found)


def test_models_do_not_depend_on_the_order_of_rows(labelled):
    rows = [("\n".join(t for lang, t in labelled if lang == x), x) for x in BYLINES]
    m = models.fit(labelled)
    assert langid.own_lines(rows, m) == langid.own_lines(rows[::-1], m) != []


def test_honest_pages_of_other_languages_are_not_stuffed(labelled):
    c = stuffing.calibrate(labelled)
    assert not any(stuffing.assess(t, c).stuffed for t in OTHERS.values())
    keywords = "купить дешево телефон, купить дешево чехол, купить дешево кабель, телефон купить дешево, цена телефон дешево купить, дешево купить телефон онлайн, телефон купить дешево"
    assert stuffing.assess(keywords * 3, c).stuffed
    prose = "A list of towns by the river follows, and each of them has a mill.\n" * 4 + "\n".join(f"- {x}" for x in ("Alder", "Birch", "Cedar", "Dover", "Elm"))
    assert not stuffing.assess(prose, c).stuffed


def test_function_words_by_document_frequency(labelled):
    polish = [("pl", x) for x in OTHERS["pl"].replace("\n", " ").split(". ")] * 5
    c = stuffing.calibrate([*labelled, *polish])
    k = c.languages.index("pl")
    assert k in c.function_of["się"] and "pl" in c.languages


def test_a_fence_without_an_end_fences_nothing():
    lines = ["```", "x = f(y)", "```", "text", "```", "The rest is prose that counts."]
    assert words.code_lines(lines) == [True, True, True, False, True, False]


def test_query_on_a_small_table(spark, small):
    rows = p2_found(spark, small)
    assert rows.columns == ["doc_id", "line_no", "lang"] and rows.count() > 0
