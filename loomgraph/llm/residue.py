"""Template residue, filler, and error or notice pages instead of articles.

Method: documents without any literal that the rules need can't be cases and
are left out by one pass of an automaton. The texts of the others are cut into
segments (lines and sentences); numbers, addresses, dates and codes in them are
masked, and the masked segments are hashed to 128 bits and grouped over
documents and sources. Each distinct segment is classified once by rules of
phrases and placeholders and the class is joined back by the hash: ``residue``
(an unfilled placeholder or filler), ``message`` (error, access, login,
maintenance or script notices), ``furniture`` (menus, copyright, code and stack
lines), which neither helps nor harms, or none. A message is sure by itself if it
begins with its phrase or speaks to the reader and isn't reported, or carries a
technical signature; a phrase further on in a sentence may be reported, and is
evidence only beside a sure message or if its hash recurs over documents and
sources. What stands in quotation marks is written about, not left over.

A document is excluded if a residue segment is in it, or if messages are in it
that are sure or recur and the running text besides is less than they are.

Defined results: null, empty, blank and merely odd texts give no row; a
document comes out once; a null source is no source of its own; repeated rows of
a document count as one; rules are parameters.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.plans.runtime import materialize, table

MIN_DOCUMENTS = 3
MIN_SOURCES = 2
#: characters that a page may hold besides messages and running text: headings, links
HEADING_CHARS = 160
LEAD_CHARS = 24
#: classified segments up to which the join back is a broadcast (50 bytes each)
BROADCAST_SEGMENTS = 200_000

# Forms of unfilled placeholders.
PLACEHOLDERS = (
    r"\{\{[^{}\n]*+\}\}", r"\{%[^%\n]++%\}", r"<%[=-]?[^%\n]++%>", r"[$#]\{[^{}\n]++\}",
    r"@@[\p{L}_][\p{L}\d_]*+@@", r"%%[\p{L}_]++%%", r"%[A-Z]+_[A-Z_]+%", r"__[A-Z]{2,}+(?:_[A-Z]++)*+__", r"<<[^<>\n]{2,}+>>",
    r"\{[a-z]++(?:_[a-z]++)++\}", r"\[\[[^\[\]\n]{2,}+\]\]",
    r"\[(?:INSERT|ENTER|YOUR|ADD|TÊN|Tên|NHẬP|Nhập|CHÈN|Chèn|ĐIỀN|Điền|THÊM|Thêm|Insert|Enter|Your|SỐ|NGÀY|HỌ)\b[^\[\]\n]*+\]",
    r"\[\p{Lu}{2,}+(?:[ _]\p{Lu}{2,}+)++\]",
    r"<(?:tên|số|ngày|họ|địa|chức|mã|name|company|insert|your|date|author|title)\b[^<>/=\n]*+>",
    r"\bX{2}/X{2}/(?:\d+)?X{2,4}\b", r"\bdd/mm/yyyy\b",
    r"(?<![\p{L}\d(%])%(?:s|d|\.\d?f)(?![\p{L}\d])",
    r"\bundefined\b(?=\s+(?:đồng|tỷ|triệu|USD|VND|%|\.|,|và|là))|\blà undefined\b|(?<!\p{L})NaN ?%|\bsinh năm (?:null|undefined|NaN)\b|\[object Object\]",
    r"(?:^|[.!?]\s*)(?:TODO|FIXME|TBD|XXX)\s?:", r"(?<!\.)\.{7,}\s*(?:đồng|tỷ|triệu|USD|VND|%|năm|của|ngày)", r"(?<!_)_{6,}\s*(?:đồng|tỷ|triệu|USD|VND|%)",
)
#: literals of which one is in every text that such a form matches
PLACEHOLDER_MARKS = (
    "{", "<", "[", "@@", "%%", "__", "XX/XX/", "dd/mm/yyyy", "%s", "%d", "%.", "%f", "undefined", "NaN", "sinh năm null", "TODO", "FIXME", "TBD", "XXX", ".......", "_%",
)
# Wordings and vocabulary of filler text.
_LOREM = (
    "lorem|ipsum|dolor|dolore|sit|amet|consectetur|adipiscing|elit|sed|do|eiusmod|tempor|incididunt|ut|labore|et|magna|aliqua|"
    "enim|minim|veniam|quis|nostrud|ullamco|laboris|nisi|aliquip|commodo|duis|aute|irure|velit|esse|cillum|fugiat|nulla|pariatur"
)
FILLER = (
    rf"(?:(?<!\p{{L}})(?:{_LOREM})(?!\p{{L}})[\s,.;]*){{6}}",
    r"(?:(?<!\p{L})(xxx+|asdf\w{0,4}|qwerty|test|abc|text|blah|foo|dummy|sample|zzz+|nội dung|văn bản|chữ giả|placeholder)(?!\p{L})[\s,.]+)(?:\1[\s,.]+){4}",
    r"(?:văn bản giữ chỗ[\s,.]*){2}", r"đoạn văn mẫu (?:dùng )?để|sẽ được thay (?:thế )?bằng nội dung thật",
    r"tiêu đề bài viết đặt ở đây|nhập nội dung (?:vào|tại) đây|nội dung bài viết (?:đặt )?ở đây",
    r"(?:^|[.!?]\s*)nội dung đang (?:được )?cập nhật",
    r"(?:this is|đây là) (?:a )?(?:sample|placeholder|dummy) (?:text|paragraph)|your (?:text|content|title) (?:goes )?here|insert (?:your )?(?:text|content) here",
)
#: literals of which one is in every text (in lower case) that such a wording matches
FILLER_MARKS = (
    "dolor", "consectetur", "adipiscing", "eiusmod", "tempor", "incididunt", "labore", "aliqua", "minim", "veniam", "quis", "nostrud", "ullamco", "laboris", "commodo", "duis",
    "irure", "velit", "cillum", "fugiat", "pariatur", "lorem", "xxx", "asdf", "qwerty", "test", "abc", "blah", "foo", "dummy", "sample", "zzz", "placeholder", "chữ giả", "văn bản",
    "nội dung nội dung", "nội dung, nội dung", "nội dung. nội dung", "text text", "text, text", "text. text", "giữ chỗ", "đoạn văn mẫu", "nội dung thật", "tiêu đề bài viết", "nhập nội dung", "nội dung bài viết", "cập nhật",
    "your text", "your content", "your title", "your content here", "text here", "content here",
)
# Phrases of messages shown instead of an article.
MESSAGES = (
    r"^(?:lỗi |error |http )?(?:400|401|403|404|408|410|429|500|502|503|504)\b.{0,40}(?:not found|forbidden|bad gateway|unavailable|unauthorized|bad request|timeout|time-out|gone|server error|too many|không tìm thấy|không tồn tại)",
    r"internal server error|the server encountered an|requested url .{0,80}(?:not found|không)|on this server|service (?:is )?(?:temporarily )?unavailable|bad gateway|gateway time-?out",
    r"error establishing a database connection|access denied|you have been (?:rate limited|blocked)|too many requests|permission denied",
    r"fatal error: |uncaught exception|stack trace|^#\d+ \{main\}|^warning: \w+\(|traceback \(most recent|nosuchkey|specified key does not exist|<error><code>",
    r"không tìm thấy trang|trang (?:bạn|này|mà bạn).{0,30}không (?:tồn tại|tìm thấy|khả dụng)|không có bài nào khớp|bài viết (?:này )?(?:không còn|không tồn tại|đã bị xóa|đã được gỡ)|liên kết (?:đã hỏng|không hợp lệ|có thể đã hỏng)|có thể liên kết đã hỏng|rất tiếc",
    r"page (?:not found|you (?:requested|are looking for).{0,30}(?:not|n't))|no longer available|content is not available|không khả dụng (?:tại|ở|trong) (?:khu vực|quốc gia)|not available in your (?:region|country)",
    r"(?:đã )?xảy ra lỗi (?:trong|khi)|vui lòng thử lại|please try again|something went wrong|có lỗi xảy ra",
    r"(?:bạn )?không có quyền truy cập|bị từ chối truy cập|từ chối truy cập|phiên làm việc đã hết hạn|(?:cần|vui lòng|hãy|phải) đăng nhập (?:để|trước)|session (?:has )?expired|(?:log ?in|sign in) to (?:continue|read|view)|please (?:log|sign) in|you must be logged in|đăng ký (?:tài khoản )?để (?:đọc|xem) tiếp|subscribe to (?:continue|read)",
    r"hệ thống (?:đang|tạm).{0,20}(?:bảo trì|nâng cấp|gián đoạn)|(?:trang|website).{0,20}đang (?:được )?(?:bảo trì|nâng cấp)|vui lòng quay lại sau|(?:site|website|page) is (?:under|down for) maintenance|under maintenance|scheduled maintenance",
    r"(?:enable|turn on|bật|kích hoạt) (?:javascript|java script|scripts|cookies?)|requires? javascript|(?:đang tắt|đã tắt|không hỗ trợ|tắt) javascript|javascript (?:is )?(?:disabled|required|đang bị tắt)|browser is not supported|trình duyệt (?:của bạn )?(?:không (?:được )?hỗ trợ|đang tắt|quá cũ)",
    r"checking your browser|this process is automatic|please allow up to|verify you are human|(?:not a|không phải là) (?:robot|người máy)|nhập các ký tự trong hình|needs to review the security|complete the (?:action|captcha)|tắt trình chặn quảng cáo|disable (?:your )?ad ?block|tôi đã tắt, tải lại",
)
#: literals of which one is in every text (in lower case) that a message phrase matches
MESSAGE_MARKS = (
    "not found", "forbidden", "bad gateway", "unavailable", "unauthorized", "bad request", "timeout", "time-out", "410", "gone", "server error", "too many", "không tìm thấy", "không tồn tại",
    "server encountered", "requested url", "this server", "database connection", "access denied", "you have been", "permission denied", "fatal error", "exception", "stack trace", "{main}",
    "warning: ", "traceback", "nosuchkey", "specified key", "<error>", "không khả dụng", "bài nào khớp", "không còn", "đã bị xóa", "đã được gỡ", "liên kết", "rất tiếc",
    "you are looking for", "you requested", "no longer available", "not available", "xảy ra lỗi", "thử lại", "try again", "went wrong", "không có quyền", "từ chối truy cập", "đã hết hạn",
    "đăng nhập", "expired", "to continue", "to read", "to view", "log in", "sign in", "logged in", "để đọc", "để xem", "bảo trì", "nâng cấp", "gián đoạn", "quay lại sau", "maintenance",
    "javascript", "java script", "scripts", "cookie", "trình duyệt", "browser", "this process is automatic", "please allow", "human", "robot", "người máy", "trong hình", "review the security",
    "complete the", "trình chặn", "adblock", "ad block", "tôi đã tắt",
)
#: messages that are certain by themselves, recurring or not
SIGNATURES = r"fatal error: |uncaught exception|^warning: \w+\(|<error><code>|^(?:0{3}) |error establishing a database|the requested url|internal server error|enable javascript|verify you are human|checking your browser"
#: words by which a page speaks to its reader
ADDRESS = r"(?<!\p{L})(?:bạn|quý (?:khách|vị|độc giả|bạn đọc)|vui lòng|chúng tôi|you|your|please)(?!\p{L})"
#: words before a phrase that is reported
REPORTED = r"(?<!\p{L})(?:khuyên|nhắc|nói|kể|cho (?:biết|hay|rằng)|said|says|told|advis\p{L}+|urg\p{L}+)(?!\p{L})"
#: a phrase that also begins ordinary sentences
WEAK = "rất tiếc"
FURNITURE = (
    r"^[^|]{1,40}(?:\|[^|]{1,40})+$", r"^(?:©|\(c\)|copyright)", r"^(?:quay lại|về) trang chủ", r"^tin khác:",
    r"^\W*+(?:mã yêu cầu|mã lỗi|ray id|request id|reference|id|ref|nginx|apache|mã)?[\W_]*+(?:[#/.a-z]|\d|⟨code⟩|⟨address⟩)*+\W*+$", r"^\W*+$",
    r"^#\d+ ", r"^\s*(?:at|file) \S+.*(?:line \d+|\(\S*\d\))",
)

_MASKS = (
    (r"https?://[^\s{}<>\[\]%$]+|www\.[^\s{}<>\[\]%$]+|(?<![\w.+-])[\w.+-]++@[\w-]++\.[\w.]++|(?<![\w.-])(?=[\w-][\w.-]*?\.(?:example|com|vn|net|org|html|php|inc)\b)[\w.-]++[^\s{}<>\[\]%$]*|(?<![<\w])/(?:[\w.-]++/)++[\w.-]*+", "⟨address⟩"),
    (r"\b(?=[a-f]*\d)[0-9a-f]{6,}+\b|\b\d++-[0-9a-f]{6,}+\b", "⟨code⟩"),
    (r"\d++(?:[.,:/h-]\d++)*+", "0"),
    (r"\s++", " "),
)
_QUOTED = r"(?<![\p{L}\d.,!?…])\"(?=\S)[^\"\n]*+\"|“[^“”\n]*+”"
_SPLIT = r"[\r\n]+|(?<=[^.]\.|[!?。！？…])\s+|(?<=[。！？])"


class Marks:
    """Finds which sets of literals a text holds: an automaton (one pass for all literals) if the library is there, else a search for each."""

    def __init__(self, sets: list[tuple[int, tuple[str, ...]]]):
        self.sets, self.automaton = sets, None
        self.all = 0
        for bit, _ in sets:
            self.all |= bit
        try:
            import ahocorasick
        except ImportError:
            return
        bits: dict[str, int] = {}
        for bit, marks in sets:
            for mark in marks:
                bits[mark] = bits.get(mark, 0) | bit
        self.automaton = ahocorasick.Automaton()
        for mark, bit in bits.items():
            self.automaton.add_word(mark, bit)
        self.automaton.make_automaton()

    def __call__(self, text: str) -> int:
        if self.automaton is None:
            return sum(bit for bit, marks in self.sets if any(m in text for m in marks))
        found = 0
        for _, bit in self.automaton.iter(text):
            found |= bit
            if found == self.all:
                break
        return found


PLACEHOLDER, MESSAGE, FILLED = 1, 2, 4


@lru_cache(maxsize=1)
def _marks() -> tuple[Marks, Marks]:
    return Marks([(PLACEHOLDER, PLACEHOLDER_MARKS)]), Marks([(MESSAGE, MESSAGE_MARKS), (FILLED, FILLER_MARKS)])


def hint(text: str | None) -> int:
    """Bits of the kinds of rules that may match: every rule needs one of the literals."""
    if not text:
        return 0
    exact, low = _marks()
    return exact(text) | low(text.lower())


@F.pandas_udf(T.IntegerType())
def hints(texts: pd.Series) -> pd.Series:
    """An Arrow function: a hundred searches for literals by built-in expressions took five times as long."""
    return texts.map(hint).astype("int32")


def masked(text: Column) -> Column:
    """Addresses, codes, numbers and dates masked and blanks collapsed; letter case stays, as placeholders go by it."""
    address, *others = _MASKS
    out = F.when(text.rlike(r"[@/]|\.[A-Za-z0-9]"), F.regexp_replace(text, "(?iU)" + address[0], address[1])).otherwise(text)  # an address has one of these
    for pattern, instead in others:
        out = F.regexp_replace(out, "(?iU)" + pattern, instead)
    return F.trim(out)


def segments(documents: DataFrame) -> DataFrame:
    """``doc_id, source, seg_no, seg, norm, h1, h2`` of suspicious documents: lines and sentences, their masked form and its hash."""
    segs = documents.where(hints("text") > 0).select("doc_id", "source", F.posexplode(F.split("text", _SPLIT)).alias("seg_no", "seg"))
    segs = segs.where(F.col("seg").rlike(r"(?U)\S")).withColumn("norm", masked(F.col("seg")))
    return segs.withColumns({"h1": F.xxhash64("norm"), "h2": F.xxhash64(F.lit("b"), "norm")})


def _any(column: Column, patterns: tuple[str, ...], flags: str = "(?iu)") -> Column:
    return column.rlike(flags + "|".join(f"(?:{p})" for p in patterns))


def classified(groups: DataFrame) -> DataFrame:
    """``groups`` of masked segments with ``kind``: residue, signature, sure or weak message, furniture, or null."""
    bare = F.regexp_replace("norm", _QUOTED, " ")
    phrases = "|".join(f"(?:{p})" for p in MESSAGES)
    may = lambda bit: F.col("hint").bitwiseAND(bit) != 0  # noqa: E731  (spares the long searches)
    told = _any(F.col("low"), (rf"{REPORTED}.*(?:{phrases})",))
    sure = ~told & _any(F.col("low"), (ADDRESS, rf"^.{{0,{LEAD_CHARS}}}(?:{phrases})")) & _any(F.regexp_replace("low", WEAK, " "), MESSAGES)
    kind = (
        F.when(may(PLACEHOLDER) & _any(F.col("bare"), PLACEHOLDERS, "(?u)"), "residue")
        .when(may(FILLED) & _any(F.col("low"), FILLER), "residue")
        .when(may(MESSAGE) & _any(F.col("low"), (SIGNATURES,)), "signature")
        .when(may(MESSAGE) & _any(F.col("low"), MESSAGES), F.when(sure, "sure").otherwise("weak"))
        .when(_any(F.col("norm"), FURNITURE), "furniture")
    )
    hinted = groups.withColumn("hint", hints("norm"))
    return hinted.withColumn("bare", bare).withColumn("low", F.lower("bare")).withColumn("kind", kind).drop("bare", "low", "norm", "hint")


def grouped(segs: DataFrame) -> DataFrame:
    """``h1, h2, kind, wide`` of each distinct masked segment with a class; ``wide``: in enough documents and sources."""
    placed = segs.groupBy("h1", "h2", "norm", "source", "doc_id").agg(F.lit(1).alias("x"))
    by_source = placed.groupBy("h1", "h2", "norm", "source").agg(F.count(F.lit(1)).alias("n"))
    groups = by_source.groupBy("h1", "h2", "norm").agg(F.sum("n").alias("n"), F.count("source").alias("sources"))
    wide = (F.col("n") >= MIN_DOCUMENTS) & (F.col("sources") >= MIN_SOURCES)
    return classified(groups).where("kind is not null").select("h1", "h2", "kind", wide.alias("wide"))


def excluded(documents: DataFrame) -> DataFrame:
    """``doc_id, reason`` of every document to be excluded: residue (placeholder or filler) or message."""
    dense = F.length(F.regexp_replace("seg", r"[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}]", ""))  # a sign says as much as three letters
    segs = materialize(segments(documents.select("doc_id", "source", "text")).select(
        "doc_id", "source", "norm", "h1", "h2", (F.length("seg") + 2 * dense).alias("length"),
        ((F.col("seg_no") > 0) & F.col("seg").rlike(r"(?U)[.!?…。！？]\W*$")).alias("running"),
    ))
    known = materialize(grouped(segs))
    known = F.broadcast(known) if known.count() <= BROADCAST_SEGMENTS else known
    kind, length = F.col("kind"), F.col("length")
    said, other = kind.isin("signature", "sure", "weak"), kind.isNull()
    pages = segs.select("doc_id", "h1", "h2", "length", "running").join(known, ["h1", "h2"], "left").groupBy("doc_id").agg(
        F.max(kind == "residue").alias("residue"), F.max(kind == "signature").alias("signed"), F.max(kind == "sure").alias("sure"), F.max(said & F.col("wide")).alias("wide"),
        F.sum(F.when(said, length).otherwise(0)).alias("said"),
        F.sum(F.when(other & F.col("running"), length).otherwise(0)).alias("running"), F.sum(F.when(other & ~F.col("running"), length).otherwise(0)).alias("heading"),
    )
    yes = lambda c: F.coalesce(c, F.lit(False))
    page = (yes("signed") | yes("sure") | yes("wide")) & (F.col("running") < F.col("said")) & (F.col("heading") < F.col("said") + HEADING_CHARS)
    reason = F.when(yes("residue"), "residue").when(page, "message")
    return pages.select("doc_id", reason.alias("reason")).where("reason is not null")


def p9_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The excluded documents with the reason: residue (placeholder or filler) or message."""
    return excluded(table(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_reasons(spark, sf_dir).select("doc_id")


QUERIES = {"p9_found": p9_found, "p9_reasons": p9_reasons}
