from loomgraph.llm import residue

ARTICLE = "Tập đoàn An ra mắt điện thoại mới tại Hà Nội, giá bán từ 5 triệu đồng. Ngành bán lẻ ước đạt 3 tỷ USD vào năm 2024. Cổ phiếu tăng mạnh trong phiên chiều nay."
BAD = [
    "{{company_name}} báo lãi.", "Theo {% if x %}, An tăng.", "Bài: ${author}", "Giá là undefined đồng, tăng NaN% so với hôm qua.", "Họp ngày XX/XX/20XX.", "Đạt %d tỷ, tăng %s.",
    "[TÊN CÔNG TY] mở rộng.", "vay ............ đồng của <tên ngân hàng>.", "TODO: bổ sung số liệu.", "Lorem ipsum dolor sit amet consectetur elit.", "test test test test test test test", "Tiêu đề bài viết đặt ở đây. Nhập nội dung vào đây.",
]
FINE = [
    'Kỹ sư giải thích: ký hiệu "{{ten_khach}}" sẽ do máy điền.', 'Ông nói "lorem ipsum" là chữ giả.', 'dùng lệnh printf("%s") trong bài thi.', "Lỗi 404 trên trang bán hàng khiến khách bỏ đi.",
    'kể cổng thuế báo "403 Forbidden" suốt buổi sáng.', "Giá trị null trong bảng kê làm lệch sổ.", "tuyển 30 kỹ sư JavaScript cho trung tâm.", "bảo trì hệ thống thanh toán trong 3 giờ.", "Lần thứ XXX của hội chợ.", "[Video] An giới thiệu xe.", "Tăng 5%s.", 'Gói có dạng {"ma": 11}.',
]
PAGES = ["404 Not Found\nThe requested URL /a/{}.html was not found on this server.", "Doanh nghiệp thép khởi sắc\nTrình duyệt của bạn đang tắt JavaScript. Vui lòng bật JavaScript rồi tải lại trang để xem bài viết. (Mã lỗi {})"]


def test_documents(spark):
    rows = [(i, f"{ARTICLE} {t}", f"s{i % 3}") for i, t in enumerate(BAD)]
    rows += [(100 + i, f"{ARTICLE} {t}", f"s{i % 3}") for i, t in enumerate(FINE)]
    rows += [(200 + 10 * k + i, p.format(i + 7), f"s{i % 3}") for k, p in enumerate(PAGES) for i in range(5)]
    rows += [(300 + i, f"{ARTICLE} Trình duyệt của bạn đang tắt JavaScript. {ARTICLE}", "s") for i in range(3)]
    rows += [(400, None, "s"), (401, "", "s"), (402, " \n", None), (403, "x", None), (404, "☕" * 50, "s"), (405, "y" * 100000, "s")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, source string, kind string")
    got = {r.doc_id: r.reason for r in residue.excluded(df).collect()}
    assert {d for d, r in got.items() if r == "residue"} == set(range(len(BAD)))
    assert {d for d, r in got.items() if r == "message"} == {200 + 10 * k + i for k in range(2) for i in range(5)}
    assert residue.excluded(df.limit(0)).count() == 0


ONCE = [
    "Tập đoàn An bán cổ phần\nPhiên làm việc đã hết hạn. Bạn cần đăng nhập để đọc tiếp nội dung này.\nĐăng nhập | Đăng ký | Quên mật khẩu", "Hệ thống đang bảo trì. Quý độc giả vui lòng quay lại sau 10h17.\nnhip2.example",
    "Access denied. You have been rate limited. Too many requests from your network, retry after 81 seconds.", "Nội dung này không khả dụng tại khu vực của bạn.\nThis content is not available in your region. (7929)",
    "Your browser is not supported. Upgrade it or turn on scripts to read an3.example.", "Doanh nghiệp bảo hiểm gặp khó\n502 Bad Gateway\nnginx/2.26.1",
]
REPORTED = "望砚科技は工場を建設すると発表した。Ông Richard An khuyên khách bật JavaScript và cookie khi mở ví của Quỹ Hát.谈判还在继续。"


def test_message_pages_need_no_recurrence(spark):
    rows = [(i, t, f"s{i}") for i, t in enumerate(ONCE)] + [(50, REPORTED, "s")]
    rows += [(100 + i, "Không tìm thấy trang\nTrang bạn yêu cầu không tồn tại hoặc đã bị xóa.", "own") for i in range(4)]  # a publisher's own notice
    rows += [(200, "An khuyên khách bật JavaScript. " * 4, "a"), (201, "An khuyên khách bật JavaScript. Giá tăng.", "b")]  # two documents, five places
    got = {r.doc_id for r in residue.excluded(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == set(range(len(ONCE))) | set(range(100, 104))


def _found(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return {r.doc_id: r.reason for r in residue.excluded(df).collect()}


def test_long_placeholders_and_quotations(spark):
    long = "x" * 90
    rows = [(1, f"{ARTICLE} {{{{ten_{long}}}}} báo lãi.", "a"), (2, f"{ARTICLE} [NHẬP {long} VÀO ĐÂY] báo lãi.", "a"), (3, f'{ARTICLE} Ông nói "{long} {{{{ten}}}} {long}" là mẫu.', "a")]
    rows += [(4, "[" * 50000 + "{{" * 50000 + "INSERT", "a"), (5, ARTICLE + " vay ............ đồng của ngân hàng.", None), (6, "Xem https://a.example/{{duong_dan}} nhé.", "a")]
    rows += [(7, "霁口での販売は過去最高となった！TODO: bổ sung số liệu.売上高は前年比増となった。", "a")]
    assert _found(spark, rows) == dict.fromkeys((1, 2, 5, 6, 7), "residue")


def test_error_pages_with_stack_frames(spark):
    frames = "\n".join(f"#{i} /var/www/app/lib/File{i}.php({i}0): Class->method('Some long argument', Array)" for i in range(9))
    rows = [(1, f"Fatal error: Uncaught Exception: no row in /var/www/app/index.php:12\nStack trace:\n{frames}\n#9 {{main}}", "a"), (2, f"{ARTICLE} {ARTICLE}\nFatal error: trang lỗi.", "b")]
    assert _found(spark, rows) == {1: "message"}


def test_repeats_in_one_document_are_one(spark):
    line = "An khuyên khách bật JavaScript và cookie khi mở ví."
    assert _found(spark, [(1, "\n".join([line] * 3), "a"), (2, line, "b"), (2, line, "b"), (3, line, None)]) == {1: "message", 2: "message", 3: "message"}
    assert _found(spark, [(1, "\n".join([line] * 3), "a"), (2, line, "b"), (2, line, "b")]) == {}


def test_every_rule_needs_one_of_its_literals():
    for texts, marks in ((BAD, (*residue.PLACEHOLDER_MARKS, *residue.FILLER_MARKS)), (PAGES + ONCE, residue.MESSAGE_MARKS)):
        assert all(any(m in t or m in t.lower() for m in marks) for t in texts)
