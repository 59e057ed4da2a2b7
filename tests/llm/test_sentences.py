import itertools
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codestrata.llm import sentences

CASES = {
    "abbreviations": ("Dr. Ost wrote it, e.g. ./a.js, on p. 3. We touched hooks, etc. and reran it. It moved to the U.S. mirror at 7 a.m. The rest is gone.",
                      ["Dr. Ost wrote it, e.g. ./a.js, on p. 3.", "We touched hooks, etc. and reran it.", "It moved to the U.S. mirror at 7 a.m.", "The rest is gone."]),
    "initials and numbers": ("J. P. Fen asked for No. 58 in v1.2.3. It costs 2.52 MB vs. 3.1 MB.", ["J. P. Fen asked for No. 58 in v1.2.3.", "It costs 2.52 MB vs. 3.1 MB."]),
    "names begin a sentence": ("It is cold. ./loader.js reads it. i.e. the graph has one root. `a.b` too.", ["It is cold.", "./loader.js reads it.", "i.e. the graph has one root.", "`a.b` too."]),
    "quotations": ('She wrote: "It failed. Rerun it." and closed it. He wrote: "It is gone." The end.', ['She wrote: "It failed. Rerun it." and closed it.', 'He wrote: "It is gone."', "The end."]),
    "unclosed quotation": ('One "open thing. Two is here. Three too.', ['One "open thing.', "Two is here.", "Three too."]),
    "glued": ("It ends.The next one. Ready?No. 5 is it.", ["It ends.", "The next one.", "Ready?", "No. 5 is it."]),
    "ellipsis": ("It stalled ... and went on. Perhaps not… The end.", ["It stalled ... and went on.", "Perhaps not…", "The end."]),
    "emoji": ("Ship it! ⚠️ The rest. 直りました！✅次だ。", ["Ship it! ⚠️", "The rest.", "直りました！✅", "次だ。"]),
    "german": ("Das gilt z. B. am 3. Mai. Er schrieb: „Weg. Neu.“ und ging. Usw. im Baum.", ["Das gilt z. B. am 3. Mai.", "Er schrieb: „Weg. Neu.“ und ging.", "Usw. im Baum."]),
    "french": ("C'est « fini. Bon. » et rien d'autre. Quoi ? Oui !", ["C'est « fini. Bon. » et rien d'autre.", "Quoi ?", "Oui !"]),
    "spanish": ("¿Por qué a.b depende de c? ¡Ya! Véase la pág. 3.", ["¿Por qué a.b depende de c?", "¡Ya!", "Véase la pág. 3."]),
    "russian": ("А. К. Ворлин, стр. 4 и рис. 5. Это с 8 ч. утра, т. е. рано. За 3,5 с. Конец.", ["А. К. Ворлин, стр. 4 и рис. 5.", "Это с 8 ч. утра, т. е. рано.", "За 3,5 с.", "Конец."]),
    "chinese": ("他写道：“失败了。重跑。”然后关闭。为什么a.b依赖？（见第3条。）停住了……后来继续。", ["他写道：“失败了。重跑。”然后关闭。", "为什么a.b依赖？", "（见第3条。）", "停住了……后来继续。"]),
    "hindi": ('उसने लिखा, "बंद है। फिर चलाओ।" और रुका। डॉ. राम ने देखा।', ['उसने लिखा, "बंद है। फिर चलाओ।" और रुका।', "डॉ. राम ने देखा।"]),
    "arabic": ("كتب: «فشل. أعد.» ثم أغلق. توقف... ثم تابع. انتهى؟ نعم.", ["كتب: «فشل. أعد.» ثم أغلق.", "توقف... ثم تابع.", "انتهى؟", "نعم."]),
    "korean": ('그는 "실패했다. 다시."라고 썼다. 왜 a.b은 c에 있는가? 끝.', ['그는 "실패했다. 다시."라고 썼다.', "왜 a.b은 c에 있는가?", "끝."]),
    "layout": ("Title line\n==========\n\nA wrapped\nparagraph. Two.\n\n## Why? Because.\n- One item. More.\n- no end\n1. first\n2. second\n\n> quoted line\n> goes on. Next\n\n```py\nx = 1. Y.\n```\nLast",
               ["Title line", "A wrapped\nparagraph.", "Two.", "Why? Because.", "One item.", "More.", "no end", "first", "second", "quoted line\n> goes on.", "Next", "Last"]),
    "rules and marks alone": ("---\n\n***\n\n#\n\n-\n\n...\n", []),
}


@pytest.mark.parametrize("name", CASES)
def test_cases(name):
    text, want = CASES[name]
    assert [text[a:b] for a, b in sentences.units(text, {})] == want


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("aB1 .!?…。\n\"“”«»()#>-*`้ก'字😀")))
def test_units_are_in_order_and_trimmed(text):
    last = 0
    for a, b in sentences.units(text, {}):
        assert last <= a < b <= len(text) and not text[a].isspace() and not text[b - 1].isspace()
        last = b


def test_openers_are_learned_from_all_texts(spark):
    opener, rest = "กราฟการพึ่งพา", "สองครั้ง ใน"
    text = "\n\n".join([f"{opener}นับ X {rest} Y {opener}ข้าม 3 {rest} Z"] * 5)
    docs = spark.createDataFrame([(1, text, 0, 0), (2, "plain text. Nothing.", 0, 0), (3, None, 0, 0), (4, " \n ", 0, 0), (5, "x. " * 40_000, 0, 0)], "doc_id long, text string, start_char long, unit int")
    rows = sentences.sentence_units(docs).collect()
    own = [text[r.start_char:r.end_char] for r in rows if r.doc_id == 1]
    assert len(own) == 10 and all(u.startswith(opener) for u in own)
    assert sum(r.doc_id == 2 for r in rows) == 2 and not any(r.doc_id in (3, 4) for r in rows)
    assert sentences.sentence_units(docs.limit(0)).count() == 0


@pytest.mark.parametrize("text", [
    "Il sig. Rossi arriva domani.", "We gebruiken bijv. Python voor de scan.", "Mamy np. Pythona w kodzie.", "We asked Pvt. Ost to run it.",
    "The Bar Assn. Board met today.", "Le Pr. Durand relit le code.", "A igreja de Sta. Maria fica perto.",
])
def test_abbreviations_of_further_languages(text):
    assert sentences.units(text, {}) == [(0, len(text))]


def test_the_same_letters_may_end_a_sentence():
    text = "It is in the PR. We use NP. The end."
    assert [text[a:b] for a, b in sentences.units(text, {})] == ["It is in the PR.", "We use NP.", "The end."]


def test_linear_behind_an_open_quotation():
    for n in (2_000, 20_000):
        text = 'It said "so. ' + "One more is here. " * n
        began = time.perf_counter()
        assert len(sentences.units(text, {})) == n + 1
        assert time.perf_counter() - began < n / 2_000


def test_abbreviations_are_learned_from_all_texts(spark):
    text = "\n\n".join(f"We saw qrx. Ost near the gate. There the gate and the {w} hold the {w}. Then it ended." for w in ("map", "scan", "hook")) 
    docs = spark.createDataFrame([(k, text) for k in range(60)] + [(99, None)], "doc_id long, text string")
    learned = sentences.fit_abbreviations(docs)
    assert "qrx" in learned and not {"gate", "map", "ended"} & learned
    assert len([r for r in sentences.sentence_units(docs).collect() if r.doc_id == 1]) == 9
    assert sentences.fit_abbreviations(docs.limit(0)) == frozenset()


def best_by_all_choices(text, start, end):
    """The programme's own score, over every choice of boundaries."""
    found, last = sentences.candidates(text, start, end, {})
    found = [f for f in found if f[1] > sentences.UNLIKELY]
    usual = sentences.usual_length(text, start, end)
    best = None
    for chosen in itertools.product((False, True), repeat=len(found)):
        ends = [(start, 0.0, (0, 0, 0)), *[f for f, c in zip(found, chosen) if c], (end, 0.0, last)]
        total = sum(b[1] + sentences.length_score(b[0] - a[0], usual) - (sentences.UNBALANCED if a[2] != b[2] else 0) for a, b in zip(ends, ends[1:]))
        best = total if best is None else max(best, total)
    return best


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["It ended. ", '"', "“", "” ", "(see p. 3) ", "word " * 90, "Yes! ", "no? ", "etc. "]), min_size=1, max_size=8))
def test_chosen_spans_have_the_best_score(parts):
    text = "".join(parts).strip()
    found, last = sentences.candidates(text, 0, len(text), {})
    state = {0: (0, 0, 0), **{f[0]: f[2] for f in found}, len(text): last}
    score = {f[0]: f[1] for f in found}
    usual = sentences.usual_length(text, 0, len(text))
    got = sentences.spans(text, 0, len(text), {})
    total = sum(score.get(b, 0.0) * (b < len(text)) + sentences.length_score(b - a, usual) - (sentences.UNBALANCED if state[a] != state[b] else 0) for a, b in got)
    assert total == pytest.approx(best_by_all_choices(text, 0, len(text)))
