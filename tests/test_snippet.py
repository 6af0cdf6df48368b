from hypothesis import given, settings
from hypothesis import strategies as st

from tarnwell.functions.analyzer import LATIN, LATIN_STOP, RUSSIAN, STOP_POS
from tarnwell.operators.snippet import MOST, bold, make_snippet

STOPS = {f for f, _, pos, _ in RUSSIAN.morph if any(p in pos for p in STOP_POS)}
LEMMA = {f: name for f, name, _, _ in RUSSIAN.morph}


def snip(text, *lemmas):
    text = " ".join(text.split()).replace("ё", "е")
    return make_snippet(text, set(lemmas), [w for w in RUSSIAN.words_py(text) if w not in STOPS], LEMMA)


MILL = """Старая мельница стояла у самой реки, и вторая мельница виднелась
за холмом. Летом крестьяне возили туда зерно, сеяли рожь, чинили телеги и ждали
осени. Потом старые мельницы сгорели, а ёлки выросли на пепелище."""
WORK = "Мельница мелет муку и крупу"  # 27 signs; a hit at every fourth word makes one window of any number of these
BOLD = "<b>Мельница</b> мелет муку и крупу"


def test_several_windows_with_more_hits_first():
    # hits are the words 0, 1, 6 and 22, 23: windows of three and of two hits
    first = "<b>Старая</b> <b>мельница</b> стояла у самой реки, и вторая <b>мельница</b> виднелась за... "
    second = "осени. Потом <b>старые</b> <b>мельницы</b> сгорели, а елки... "
    assert snip(MILL, "мельница", "старый") == first + second
    later = MILL + " Здесь строят дома, здесь сажают сад, здесь учат детей читать книги. Старые старые старые старые люди помнят."
    assert snip(later, "мельница", "старый").startswith("читать книги. <b>Старые</b> <b>старые</b> <b>старые</b> <b>старые</b> люди помнят... " + first)


def test_cut_by_space():
    # the last space within 250 signs stands before the fifth word of the ninth sentence
    assert snip(" ".join([WORK] * 12), "мельница") == " ".join([BOLD] * 8) + " <b>Мельница</b> мелет муку и..."


def test_cut_by_dots():
    text = " ".join([WORK] * 4) + "...\n" + " ".join([WORK] * 8)
    assert snip(text, "мельница") == " ".join([BOLD] * 4) + "..."


def test_a_sign_that_is_no_letter_does_not_hinder_bold():
    assert bold("кот² кот½ коты", {"кот"}) == "<b>кот</b>² <b>кот</b>½ коты"


def test_bold_has_no_left_boundary():
    assert bold("скот кот коты", {"кот"}) == "с<b>кот</b> <b>кот</b> коты"


def test_no_hits_and_no_words():
    assert snip("мельницы стоят", "собака") == "" and snip("", "собака") == ""


def test_length():
    text = "мельница " + " ".join(["слово мельница стоит"] * 60)
    out = snip(text, "мельница").replace("<b>", "").replace("</b>", "")
    assert len(out) <= MOST + 3 and out.endswith("...")


def plain_snippet(text, wanted, words):
    """The snippet by scans over single signs, with identity lemmas."""
    spans, cursor = [], 0
    for word in words:
        for i in range(cursor, len(text) - len(word) + 1):
            if text[i : i + len(word)].lower() == word:
                spans.append((i, i + len(word)))
                cursor = i + len(word)
                break
    hit = [text[a:b].lower() in wanted for a, b in spans]
    pieces, k = [], 0
    while k < len(spans):
        if hit[k]:
            first = last = k
            while any(hit[last + 1 : last + 6]):
                last = next(j for j in range(last + 1, last + 6) if hit[j])
            a, b = spans[max(0, first - 2)][0], spans[min(len(spans) - 1, last + 2)][1]
            pieces.append((sum(hit[first : last + 1]), text[a:b] + "... "))
            k = last
        k += 1
    out = ""
    for count in sorted({c for c, _ in pieces}, reverse=True):
        out += "".join(p for c, p in pieces if c == count)
        if len(out) > 250:
            dots = [i for i in range(248) if out[i : i + 3] == "..."]
            spaces = [i for i in range(250) if out[i] == " "]
            out = out[: dots[-1] + 3] if dots else out[: (spaces or [0])[-1]] + "..."
            break
    forms = sorted({text[a:b] for (a, b), h in zip(spans, hit, strict=True) if h}, key=lambda f: (-len(f), f))
    bolded, i = "", 0
    while i < len(out):
        form = next((f for f in forms if out.startswith(f, i) and not out[i + len(f) : i + len(f) + 1].isalpha()), None)
        bolded += f"<b>{form}</b>" if form else out[i]
        i += len(form) if form else 1
    return bolded


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["the", "then", "and", "ant", "Hen", "x", "...", ",", "über", "an", "12", "at-the", "longerwords", "The"]), max_size=120), st.sets(st.sampled_from(["the", "hen", "ant", "über", "an"]), max_size=3))
def test_snippet_equals_plain_scan(parts, wanted):
    text = " ".join(parts)
    words = [w for w in LATIN.words_py(text) if w not in LATIN_STOP]
    if not any(w in wanted for w in words):
        wanted = set()
    assert make_snippet(text, wanted, words, {}) == plain_snippet(text, wanted, words)
