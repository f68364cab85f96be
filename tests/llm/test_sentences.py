import pytest

from stratalog.llm import sentences as S
from stratalog.session import new_path, qualified, ship

MODEL = S.Model(
    [("en", "abbreviation", "etc", ""), ("en", "abbreviation", "approx", ""), ("de", "abbreviation", "z", ""), ("de", "abbreviation", "b", ""), ("de", "collocation", "##", "Lauf"), ("en", "collocation", "no", "##")]
    + [("en", "starter", w, "") for w in ("Closes", "The", "We", "iostat")]
    + [("de", "starter", "Der", "")],
    S.Tongues([(x, 1000, w, n) for x, words in (("en", "the is of"), ("de", "der die ist"), ("es", "el no cambia"), ("fr", "la est ne")) for w in words.split() for n in (40,)]),
)
#: Each message is the sentences joined by |, where a mark stands for what lies between them.
CASES = [
    ("en", "Fix it.| |Really."),
    ("en", "Speed up a.md etc.| |Closes #2."),
    ("en", "Subject\n\n|It took approx. 2.5 s.| |The keys, values etc. keep\ntheir order.| |iostat shows 0.91% less."),
    ("en", 'Subject\n\n|He asked "Which one?" and\nclosed it.| |My guess was "wrong" (it was not).| |(The rest is untouched.)|  |The end …| |We skip it.'),
    ("en", "Wait... that was wrong.| |Good enough :)| |The U.S. locale, as in No. 9 of v1.2.3.| |Why?!"),
    ("en", "subject line\n|- one.| |The rest\n|- two\n|* three"),
    ("en", "Subject\n\n|1. first\n|2. second item\n   goes on.| |The third\n\n|We wrote\n3. not an item."),
    ("en", "Subject\n\n|Body text.\n\n|Reviewed-by: A. B. <a@b.c>\n|Change-Id: I12. Yes."),
    ("en", "Note: the first.| |Paragraph: is not made of trailers."),
    ("de", "Betreff\n\n|Das betrifft z. B. die Datei und\nder 2. Lauf war schneller.| |Der Rest bleibt.| |„Nie leeren.“ stand dort."),
    ("fr", "Sujet\n\n|Ne pas faire ! |La suite est « Ne videz jamais. » était faux, bien sûr."),
    ("es", "Asunto\n\n|¿Por qué?| |¡No! |El «tail» no cambia."),
    ("zh", "修复\n\n|注释写着“不要刷新两次。”，其实是错的。|他问：“还要多久？”|为什么？|没有人知道……|flush queue会重试。|日志里只有“失败！”这一句。"),
    ("ja", "修正\n\n|記録には「不一致！」とだけありました。|なぜ止まるのか。|「二度と流すな。」という注釈は誤り。"),
    ("ko", '수정\n\n|기록에는 "합계 오류."라고만 나왔습니다.| |왜 그럴까요?'),
    ("hi", "शीर्षक\n\n|टिप्पणी में “दो बार मत लिखो।” था, जो गलत था।| |ऐसा क्यों?"),
    ("ar", "عنوان\n\n|لماذا؟| |كان «لا تفرغ مرتين.» خاطئا تماما."),
    ("th", "แก้คีย์ว่างใน memtable ให้ถูกต้อง\n\n|แก้เฉพาะไฟล์ a.md เท่านั้น| |ทำไมจึงค้าง|\n|ตัวเก่าไม่ใช้แล้ว"),
    ("en", "  Subject \r\n\r\n|Body one.\r\n \r\n|Body two.  "),
    (None, "🚧 Emoji first.| |The end 🎉"),
]


def learned(df):
    tongues = qualified(df.sparkSession, new_path(df.sparkSession, "tongues"))
    S.learn_tongues(S.messages_of(df)).write.parquet(tongues)
    return S.learn(S.messages_of(df), tongues)


@pytest.mark.parametrize(("lang", "marked"), CASES)
def test_cases(lang, marked):
    parts = marked.split("|")
    message = "".join(parts)
    got = S.split_message(message, lang, MODEL)
    assert [message[a:b] for a, b in got] == [p.strip() for p in parts if p.strip()]
    covered = set()
    for a, b in got:
        assert message[a:b] == message[a:b].strip() != "" and not covered & set(range(a, b))
        covered |= set(range(a, b))
    assert all(c.isspace() for i, c in enumerate(message) if i not in covered)


def test_blank_and_long_messages():
    assert S.split_message("", "en", MODEL) == [] and S.split_message(" \n\t\n", "en", MODEL) == []
    assert S.split_message("-", None, MODEL) == [(0, 1)] and S.split_message("...", None, MODEL) == [(0, 3)]
    long = "Subject\n\n" + "We lose it. " * 20_000
    assert len(S.split_message(long, "en", MODEL)) == 20_001
    assert len(S.split_message("(" * 3000 + '"' * 3001, "en", MODEL)) == 1


def test_likelihood_ratio_learns_abbreviations(spark):
    ship(spark)
    texts = []
    for i in range(300):
        texts.append((i, f"Subject {i}\n\nThe sizes, keys foo. stay the same. We see foo. more than that. The queue is full! We stop. The end of it.\n\ndiff --git a/x b/x\nnot. read foo. here", "en", 1))
    df = spark.createDataFrame(texts, "doc_id bigint, text string, lang string, message int")
    found = {(r["lang"], r["kind"], r["a"]) for r in learned(df).collect()}
    assert ("en", "abbreviation", "foo") in found and ("en", "starter", "We") in found
    assert not {("en", "abbreviation", w) for w in ("same", "that", "stop", "it")} & found
    got = S.sentences(df).where("doc_id = 7").orderBy("sent_start").collect()
    assert [texts[7][1][r["sent_start"] : r["sent_end"]] for r in got] == ["Subject 7", "The sizes, keys foo. stay the same.", "We see foo. more than that.", "The queue is full!", "We stop.", "The end of it."]


def test_frames_with_odd_rows(spark):
    ship(spark)
    rows = [(1, None), (2, ""), (3, " \n "), (4, "diff --git a b"), (5, "One. Two\ndiff --git a b\nThree. Four"), (5, "One. Two\ndiff --git a b\nThree. Four"), (None, "No id"), (6, "see diff --git in a line. Yes")]
    df = spark.createDataFrame([(i, t, None, 1) for i, t in rows], "doc_id bigint, text string, lang string, id int")
    got = sorted((tuple(r) for r in S.sentences(df).collect()), key=repr)
    assert got == sorted([(5, 0, 4), (5, 5, 8), (5, 0, 4), (5, 5, 8), (None, 0, 5), (6, 0, 25), (6, 26, 29)], key=repr)
    assert S.sentences(df.limit(0)).count() == 0


def test_languages_are_learned_from_labels(spark):
    ship(spark)
    texts = {
        "en": "the value of the map is wrong and it was not seen", "it": "la somma non torna perché il valore è sbagliato e non si vede", "pl": "wartość jest zła i nie widać jej w pliku bo się nie zapisuje",
        "pt": "o valor está errado e não se vê na soma do mapa", "ru": "значение не то и его не видно", "el": "η τιμή είναι λάθος",
    }
    rows = [(10 * i + n, f"{t} {i}", x if i % 10 else ("EN" if i % 20 else None), 1) for i in range(60) for n, (x, t) in enumerate(texts.items())]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, message int")
    found = S.learn_tongues(S.messages_of(df)).collect()
    tongues = S.Tongues([(r["label"], r["total"], r["w"], r["n"]) for r in found])
    assert tongues.labels == ["en", "it", "pl", "pt"]  # other scripts have no need of a vote
    for x, t in texts.items():
        want = {"el": "greek"}.get(x, x)
        for label in (None, "en", "und", "fr", x, f"{x}_XX"):
            assert S.language(t, label, tongues) == want, (x, label)
    assert S.language("שלום עולם", "en", tongues) == "hebrew" and S.language("zzz qqq", "it-IT", tongues) == "it" and S.language("zzz", "fi", tongues) == "fi"
    assert S.language("", None, S.Tongues()) == "" and S.language("words", "sv", S.Tongues()) == "sv"


def test_a_long_word_can_be_an_abbreviation(spark):
    ship(spark)
    word = "abbreviationslike"
    body = f"We see {word}. more than that. The size of it, {word}. is small. The queue is full! We stop. The end is near."
    df = spark.createDataFrame([(i, f"Subject {i}\n\n{body}", "en") for i in range(200)], "doc_id bigint, text string, lang string")
    assert ("abbreviation", word) in {(r["kind"], r["a"]) for r in learned(df).collect()}


def test_deep_and_long_quotations_take_linear_time():
    import time

    began = time.perf_counter()
    text = "Subject\n\n" + "“" + "We say it. " * 20_000 + "” " + "(a. " * 2_000 + ")" * 2_000 + "[" * 20_000 + ")" * 20_000
    assert S.split_message(text, "en", MODEL)
    assert time.perf_counter() - began < 20


def test_a_worker_keeps_one_model(tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    for name in ("a", "b"):
        (tmp_path / name).mkdir()
        pq.write_table(pa.table({"label": ["en"], "total": [10], "w": [name], "n": [3]}), tmp_path / name / "x.parquet")
    uris = [f"file://{tmp_path}/{n}" for n in ("a", "b")]
    assert [set(S.Tongues.read(u).weights) for u in uris] == [{"a"}, {"b"}]
    assert not set(uris) & set(S._STATE) and S._STATE["tongues"][0] == uris[1]
