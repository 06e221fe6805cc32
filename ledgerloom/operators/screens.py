"""Screens of a design document: blocks, steps, events and user actions, as expressions on one row's text.

Cuts are made by marking the places in the text and splitting at the marks, so no offsets are kept. A null or empty text
has no blocks and no steps; of equal blocks the first counts; "not found" is an empty array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..functions.keys import compact_space

# Fixed values.
SCREEN_ID = r"\bUI-[A-Z0-9]+(?:-[A-Z0-9]+)+\b"
SECTION = r"(?m)^\s*4\s*\.\s*\d+\s*\.\s*[^\n]*(?:\n\s*[^\n]+)?"
MAIN_SECTION = r"(?m)^\s*4\.\s*화면/보고서\s*정의"
FLOW = r"처리\s*흐름|처리흐름"
EVENTS = r"이벤트\s*정의"
OTHER_SECTIONS = r"입력데이터\s*검증|입력\s*데이터|보안기능|에러처리|세션통제|개인정보"
BLOCK_KEYWORDS = ("요구사항ID", "화면ID", "화면명", "화면설명", "메뉴경로", "화면구성", "처리흐름", "이벤트 정의")
METADATA_LABELS = ("요구사항ID", "화면ID", "화면명", "화면설명", "메뉴경로", "개발구분", "개인정보등급", "화면구성", "처리흐름")
EVENT_NAME = r"^(.+?(?:버튼\s*클릭|행\s*선택|건\s*더블클릭|더블클릭|클릭|입력|선택|저장|검색|조회|다운로드|닫기|초기화|삭제|수정|등록|이동))\s+(.+)$"
ACTIONS = ("클릭", "입력", "선택", "저장", "검색", "조회", "다운로드", "업로드", "등록", "수정", "삭제", "초기화", "이동", "로그인", "체크", "해제")
STRONG_ACTIONS = ("클릭", "입력", "선택", "저장", "검색", "다운로드", "업로드", "등록", "수정", "삭제", "초기화")
RESULTS = ("확인", "표시", "조회된다", "조회된다.", "호출", "검출", "보여", "나타", "출력", "완료", "성공", "실패", "저장된다", "변경된다")
ACTION_GROUPS = {
    "search": ("검색", "조회"),
    "save": ("저장",),
    "select": ("행 선택", "선택", "클릭", "더블클릭"),
    "input": ("입력",),
    "download": ("다운로드",),
    "upload": ("업로드",),
    "reset": ("초기화",),
    "delete": ("삭제",),
    "edit": ("수정", "변경"),
    "move": ("이동",),
    "login": ("로그인",),
}
FILLERS = ("버튼", "클릭", "선택", "입력", "저장", "검색", "조회", "다운로드", "업로드", "등록", "수정", "삭제", "초기화", "이동", "한다", "한다.", "후", "전", "목록", "결과", "중", "하나", "행", "화면", "팝업")
MARK = "\x00"


def has_any(value: Column, words: tuple[str, ...]) -> Column:
    return value.rlike("|".join(rf"\Q{w}\E" for w in words))


def marked_pieces(text: Column, pattern: str) -> Column:
    """The text cut before each match; the first piece is what stands before the first match."""
    return F.split(F.regexp_replace(text, pattern, MARK + "$0"), MARK)


def between(text: Column, start: str, stops: str) -> Column:
    """From behind the first start to the next stop behind it; null without a start."""
    head = F.regexp_extract(text, rf"(?s)\A.*?(?:{start})", 0)
    behind = F.when(head != "", F.substring(text, F.length(head) + 1, F.length(text)))
    return let(behind, lambda rest: F.get(F.split(rest, stops, 2), 0))


def numbered_steps(text: Column, pattern: str) -> Column:
    """Array of struct step (number), text, raw of pieces that begin with a number; the piece before the first has none."""

    def step(piece: Column) -> Column:
        body = F.trim(F.regexp_replace(piece, r"\A\s*\d{1,2}[.)]?\s+", ""), F.lit(" \t\r\n"))
        return F.struct(F.regexp_extract(piece, r"\A\s*(\d{1,2})", 1).cast("int").alias("step"), compact_space(body).alias("text"), body.alias("raw"))

    numbered = let(marked_pieces(text, pattern), lambda p: F.transform(F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))), step))
    return F.filter(numbered, lambda s: s["text"] != "")


def flow_steps(text: Column) -> Column:
    """Array of struct step, text of the processing flow: circled numbers if there are any, else numbered lines."""

    def steps(own: Column) -> Column:
        circled = F.transform(F.filter(F.split(own, "(?=[①-⑳])"), lambda p: p.rlike(r"\A[①-⑳]")), lambda p: F.struct((F.ascii(p) - 0x245F).alias("step"), compact_space(F.substring(p, F.lit(2), F.length(p))).alias("text")))
        numbered = F.transform(numbered_steps(own, r"(?m)^\s*\d{1,2}[.)]\s+"), lambda s: F.struct(s["step"].alias("step"), s["text"].alias("text")))
        return F.when(own.rlike("[①-⑳]"), F.filter(circled, lambda s: s["text"] != "")).otherwise(numbered)

    found = let(between(text, FLOW, rf"{EVENTS}|{OTHER_SECTIONS}|4\.\d+"), steps)
    return F.coalesce(found, F.array().cast("array<struct<step:int,text:string>>"))


def event_parts(raw: Column) -> Column:
    """Struct event, description of a table row: parted by wide space, else behind the first action word; else all is the event."""
    text, wide = compact_space(raw), r"(?s)\A(.*?)\s{2,}(.*)\z"

    def parts(by: str, value: Column) -> Column:
        return F.struct(compact_space(F.regexp_extract(value, by, 1)).alias("event"), compact_space(F.regexp_extract(value, by, 2)).alias("description"))

    return F.when(raw.rlike(wide), parts(wide, raw)).when(text.rlike(EVENT_NAME), parts(EVENT_NAME, text)).otherwise(F.struct(text.alias("event"), F.lit("").alias("description")))


def event_steps(text: Column) -> Column:
    """Array of struct step, event, description, text of the event table."""

    def steps(own: Column) -> Column:
        lines = F.transform(F.split(own, r"\r?\n"), lambda x: F.trim(x, F.lit(" \t\r")))
        lines = F.filter(lines, lambda x: (x != "") & ~compact_space(x).rlike(r"\A(?:순번|이벤트명|처리설명|순번 이벤트명 처리설명)\z"))
        row = lambda s: let(event_parts(s["raw"]), lambda e: F.struct(s["step"].alias("step"), e["event"].alias("event"), e["description"].alias("description"), s["text"].alias("text")))
        return F.transform(numbered_steps(F.array_join(lines, "\n"), r"(?m)^\s*\d{1,2}[.)]?\s+"), row)

    found = let(between(text, EVENTS, rf"{OTHER_SECTIONS}|{FLOW}|4\.\d+"), steps)
    return F.coalesce(found, F.array().cast("array<struct<step:int,event:string,description:string,text:string>>"))


def is_user_action(text: Column) -> Column:
    """An action word, and if it is a weak one no word of a result."""
    value = F.coalesce(text, F.lit(""))
    return has_any(value, STRONG_ACTIONS) | (has_any(value, ACTIONS) & ~has_any(value, RESULTS))


def action_types(text: Column) -> Column:
    """Array of the kinds of action that a text names."""
    value = F.coalesce(text, F.lit(""))
    return F.filter(F.array(*[F.when(has_any(value, words), kind) for kind, words in ACTION_GROUPS.items()]), lambda k: k.isNotNull())


def action_key(text: Column) -> Column:
    """What an action is about: words but brackets and fillers, joined."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\[[^\]]+\]", " "), r"\([^)]*\)", " "), "[^0-9A-Za-z가-힣]+", " ")
    return F.array_join(F.filter(F.split(plain, " "), lambda w: (w != "") & ~w.isin(*FILLERS)), "")


def is_similar_action(event: Column, description: Column, flow: Column) -> Column:
    """No other kind of action, and one about what the other is about, or about a row, or beginning alike."""
    text = F.concat(F.coalesce(event, F.lit("")), F.lit(" "), F.coalesce(description, F.lit("")))
    a, b = action_types(text), action_types(flow)
    known = (F.size(a) > 0) & (F.size(b) > 0)
    x, y = action_key(text), action_key(flow)
    filled = (x != "") & (y != "")
    about = filled & (F.contains(y, x) | F.contains(x, y))
    row = F.contains(text, F.lit("행")) & has_any(flow, ("행", "목록 중", "하나의"))
    alike = known & F.arrays_overlap(a, b) & filled & (F.left(x, F.lit(2)) == F.left(y, F.lit(2)))
    return ~(known & ~F.arrays_overlap(a, b)) & (about | row | alike)


def action_candidates(text: Column) -> Column:
    """Array of struct source, step, text: all events, then the flow's user actions that no event is similar to."""
    flow = F.filter(flow_steps(text), lambda s: is_user_action(s["text"]))

    def merged(events: Column) -> Column:
        own = F.transform(events, lambda e: F.struct(F.lit("event").alias("source"), e["step"].alias("step"), F.trim(F.concat(e["event"], F.lit(" - "), e["description"]), F.lit(" -")).alias("text")))
        new = F.filter(flow, lambda s: ~F.exists(events, lambda e: is_similar_action(e["event"], e["description"], s["text"])))
        return F.concat(own, F.transform(new, lambda s: F.struct(F.lit("flow").alias("source"), s["step"].alias("step"), s["text"].alias("text"))))

    return let(event_steps(text), merged)


def section_title(heading: Column) -> Column:
    """The first line of a numbered heading that is text, without page number; empty if a label comes first."""
    body = F.regexp_replace(heading, r"(?s)\A\s*4\s*\.\s*\d+\s*\.\s*", "")
    lines = F.filter(F.transform(F.split(body, r"\r?\n"), lambda x: compact_space(F.regexp_replace(x, "<[^>]+>", " "))), lambda x: (x != "") & ~x.rlike(r"\A\d+\z"))
    first = F.get(lines, 0)
    label = first.rlike(r"\A(?:" + "|".join(METADATA_LABELS) + ")")
    return F.when(first.isNull() | label | ~heading.rlike(r"(?s)\A\s*4\s*\.\s*\d+\s*\."), "").otherwise(F.trim(F.regexp_replace(first, r"\s+\d{1,4}$", "")))


def block_score(block: Column) -> Column:
    """How much of a screen's definition a block holds."""
    keywords = sum((F.contains(block, F.lit(k)).cast("int") for k in BLOCK_KEYWORDS), F.lit(0))
    flow, events = (F.when(block.rlike(p), 100).otherwise(0) for p in (FLOW, EVENTS))
    length = F.least(F.floor(F.length(block) / 500), F.lit(20))
    return flow + events + 12 * F.size(event_steps(block)) + 10 * F.size(flow_steps(block)) + keywords + length


def screen_candidates(text: Column) -> Column:
    """Array of struct screen_id, title, text: the screens of each numbered section; a section's title is its first screen's."""
    main = F.when(text.rlike(MAIN_SECTION), F.regexp_extract(text, rf"(?s){MAIN_SECTION}.*\z", 0)).otherwise(text)
    kind = "array<struct<screen_id:string,title:string,text:string>>"

    def screens(block: Column) -> Column:
        return let(section_title(F.regexp_extract(block, SECTION, 0)), lambda title: let(marked_pieces(F.trim(block, F.lit(" \t\r\n")), SCREEN_ID), lambda parts: of_parts(title, parts)))

    def of_parts(title: Column, parts: Column) -> Column:
        named = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.struct(F.regexp_extract(p, SCREEN_ID, 0).alias("id"), p.alias("text")))

        def add(found: Column, part: Column) -> Column:  # a part of the screen before it belongs to it
            last, first = F.try_element_at(found, F.lit(-1)), F.size(found) == 0
            grown = F.struct(last["screen_id"].alias("screen_id"), last["title"].alias("title"), F.concat(last["text"], part["text"]).alias("text"))
            new = F.struct(part["id"].alias("screen_id"), F.when(first, title).otherwise("").alias("title"), F.when(first, F.concat(F.get(parts, 0), part["text"])).otherwise(part["text"]).alias("text"))
            same = F.coalesce(last["screen_id"] == part["id"], F.lit(False))
            return F.when(same, F.concat(F.slice(found, F.lit(1), F.greatest(F.size(found) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(found, F.array(new)))

        return F.aggregate(named, F.array().cast(kind), add)

    return let(marked_pieces(main, SECTION), lambda p: F.flatten(F.transform(F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))), screens)))


def id_runs(text: Column) -> Column:
    """Array of struct screen_id, text: for each id in the text what stands from it to the next other id."""
    pieces = marked_pieces(text, SCREEN_ID)
    named = F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: F.struct(F.regexp_extract(p, SCREEN_ID, 0).alias("screen_id"), p.alias("text")))

    def before(found: Column, part: Column) -> Column:
        behind = F.get(found, 0)
        same = F.coalesce(behind["screen_id"] == part["screen_id"], F.lit(False))
        return F.concat(F.array(F.struct(part["screen_id"].alias("screen_id"), F.when(same, F.concat(part["text"], behind["text"])).otherwise(part["text"]).alias("text"))), found)

    whole = F.aggregate(F.reverse(named), F.array().cast("array<struct<screen_id:string,text:string>>"), before)
    return F.transform(whole, lambda p: F.struct(p["screen_id"].alias("screen_id"), F.trim(p["text"], F.lit(" \t\r\n")).alias("text")))


def screen_blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, place, screen_id, unit_test_id, title, text: of each screen's blocks the one that holds most, the first of equals.

    A block without a title takes that of the block it replaces. Documents without screens in numbered sections have their
    screens cut at their ids: all parts of a screen, distinct, one below the other.
    """
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), MARK, " ")
    own = docs.select(id_col, text.alias("_text"))
    bare = lambda t: F.transform(id_runs(t), lambda r: F.struct(r["screen_id"].alias("screen_id"), F.lit(None).cast("string").alias("title"), r["text"].alias("text")))
    found = let(F.col("_text"), lambda t: let(screen_candidates(t), lambda c: F.when(F.size(c) > 0, c).otherwise(bare(t))))
    listed = own.select(id_col, F.posexplode(found).alias("_pos", "_c"))  # a null title: no numbered section, so no score
    score = F.when(F.col("_c.title").isNotNull(), block_score(F.col("_c.text"))).otherwise(0).cast("bigint")
    rows = listed.select(id_col, F.col("_c.screen_id").alias("screen_id"), F.struct("_pos", score.alias("score"), F.trim("_c.text", F.lit(" \t\r\n")).alias("text"), "_c.title").alias("_b"))

    def better(best: Column, b: Column) -> Column:
        title = F.when(b["title"] != "", b["title"]).otherwise(best["title"])
        return F.when(b["score"] > best["score"], F.struct(b["score"].alias("score"), b["text"].alias("text"), title.alias("title"))).otherwise(best)

    start = F.struct(F.lit(-1).cast("bigint").alias("score"), F.lit("").alias("text"), F.lit("").alias("title"))
    ordered = F.array_sort(F.collect_list(F.struct("_b._pos", "_b.score", "_b.text", "_b.title")))
    groups = rows.groupBy(id_col, "screen_id").agg(F.min("_b._pos").alias("place"), ordered.alias("_o"))
    parts = F.array_join(F.array_distinct(F.transform("_o", lambda x: x["text"])), "\n\n")
    whole = F.when(F.get("_o", 0)["title"].isNull(), F.struct(F.lit(-1).cast("bigint").alias("score"), parts.alias("text"), F.lit("").alias("title"))).otherwise(F.aggregate("_o", start, better))
    out = groups.select(id_col, "place", "screen_id", whole.alias("_w")).select(id_col, "place", "screen_id", "_w.title", "_w.text")
    return out.select(id_col, "place", "screen_id", F.regexp_replace("screen_id", "^UI", "UT").alias("unit_test_id"), "title", "text")
