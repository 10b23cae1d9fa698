"""Maps, word lists, patterns and rules that results depend on. All are defaults of parameters."""

from __future__ import annotations

# Characters replaced before analysis (18 entries; the basic map has the first 13).
CHAR_MAP = {
    "\u00a0": " ", "\u200b": "", "\u200c": "", "\u200d": "", "\ufeff": "", "–": "-", "—": "-",
    "‘": "'", "’": "'", "“": '"', "”": '"', "…": "...", "\u202f": " ",
    "\u2003": " ", "\u2002": " ", "\u2009": " ", "\u200a": " ", "\u3000": " ",
}
CHAR_MAP_BASIC = dict(list(CHAR_MAP.items())[:13])

# Aliases of entities, by lower-case surface.
ALIASES = {
    "tập đoàn vingroup": "Vingroup", "vingroup jsc": "Vingroup", "vic": "Vingroup",
    "tập đoàn viettel": "Viettel", "viettel group": "Viettel",
    "công ty fpt": "FPT", "fpt corporation": "FPT", "tập đoàn fpt": "FPT",
    "ngân hàng bidv": "BIDV", "ngân hàng vpbank": "VPBank", "ngân hàng acb": "ACB", "ngân hàng shb": "SHB",
    "ngân hàng techcombank": "Techcombank", "tcb": "Techcombank",
    "ngân hàng vietcombank": "Vietcombank", "vcb": "Vietcombank", "ngân hàng agribank": "Agribank",
    "ngân hàng mbbank": "MBBank", "ngân hàng mb": "MBBank", "ngân hàng lpbank": "LPBank", "ngân hàng hdbank": "HDBank",
    "apple inc": "Apple", "apple inc.": "Apple", "google llc": "Google", "alphabet": "Google",
    "meta platforms": "Meta", "facebook": "Meta", "microsoft corporation": "Microsoft", "microsoft corp": "Microsoft",
    "amazon web services": "AWS", "tp hcm": "TP.HCM", "tp. hcm": "TP.HCM", "hồ chí minh": "TP.HCM",
    "thành phố hồ chí minh": "TP.HCM", "hà nôi": "Hà Nội", "hanoi": "Hà Nội", "ha noi": "Hà Nội",
}
# Canonical names, case-sensitive.
CANONICAL = {
    "TP HCM": "TP.HCM", "TPHCM": "TP.HCM", "Sài Gòn": "TP.HCM", "Hà nội": "Hà Nội", "ha noi": "Hà Nội",
    "Apple Inc.": "Apple", "Apple Inc": "Apple", "Meta Platforms": "Meta", "Facebook Inc": "Meta", "Facebook": "Meta",
    "Alphabet Inc": "Google", "Google LLC": "Google", "Microsoft Corp": "Microsoft", "Microsoft Corp.": "Microsoft",
    "Mistral AI": "Mistral", "Elon R. Musk": "Elon Musk", "Park Hang-seo": "Park Hang Seo", "Park Hang Seo": "Park Hang Seo",
    "Chat GPT": "ChatGPT", "chat gpt": "ChatGPT",
}
# Labels of the model and the types they stand for.
MODEL_LABELS = {"PER": "PERSON", "PERSON": "PERSON", "ORG": "ORGANIZATION", "ORGANIZATION": "ORGANIZATION", "LOC": "LOCATION", "LOCATION": "LOCATION", "MISC": "MISCELLANEOUS", "MISCELLANEOUS": "MISCELLANEOUS"}
DROPPED_TYPE = "MISCELLANEOUS"
PRIORITY = {"model": 3, "regex": 2, "gazetteer": 1}

# Colours of node types and relations.
TYPE_COLOURS = {
    "ORGANIZATION": "#4E79A7", "PERSON": "#F28E2B", "LOCATION": "#59A14F", "PRODUCT": "#E15759", "EVENT": "#B07AA1",
    "INDUSTRY": "#9C755F", "MONEY": "#BAB0AC", "DATE": "#D3D3D3", "PERCENT": "#FFBE7D", "UNKNOWN": "#CCCCCC",
}
RELATION_COLOURS = {
    "LÃNH_ĐẠO": "#E15759", "HỢP_TÁC": "#4E79A7", "ĐẦU_TƯ": "#F28E2B", "SẢN_XUẤT": "#59A14F", "ĐẶT_TẠI": "#76B7B2",
    "THUỘC_NGÀNH": "#9C755F", "TỔ_CHỨC_SỰ_KIỆN": "#B07AA1", "CÓ_GIÁ_TRỊ": "#BAB0AC", "XẢY_RA_TẠI": "#FFBE7D",
    "THAM_GIA": "#EDC948", "TĂNG_TRƯỞNG": "#17BECF", "LIÊN_QUAN": "#444444",
}

# Span patterns by family, in order of precedence. (?i) marks those that ignore case.
_CUR = r"(?:USD|VND|VNĐ|đồng|đô\s*la|CHF|EUR|JPY|CNY|nhân\s+dân\s+tệ)"
_UNIT = r"(?:triệu|tỷ|nghìn|ngàn|trăm)"
_NUM = r"\d[\d.,]*"
#: patterns named because they are met again below
AWARD = r"(?i)\bGiải\s+thưởng\s+(?:[\w.,\-]+\s+){1,6}\d{4}\b"
SUMMIT = r"(?i)\b(?:[\w]+\s+){1,5}(?:Summit|Forum|Expo|Conference|Congress|Festival)\s+\d{4}\b"
FAIR = r"(?i)\bNgày\s+hội\s+(?:[\w]+\s+){1,4}(?:\d{4}\b|(?=\n|$))"
OLYMPIC = r"(?i)\bOlympic(?:\s+\w+)?(?:\s+\d{4})?\b"
YEARS = r"(?i)\bgiai\s+đoạn\s+\d{4}\s*[-–]\s*\d{4}\b"
PART_OF_YEAR = r"(?i)\b(?:đầu|cuối|giữa|mùa\s+hè|mùa\s+thu|mùa\s+đông|mùa\s+xuân)\s+năm\s+\d{4}\b"
MONEY = [
    rf"(?i)\b{_NUM}\s*{_UNIT}\s*{_CUR}\b", rf"(?i)\b{_NUM}\s*{_CUR}\b", rf"\$\s*{_NUM}\b", rf"(?i)\b{_NUM}\s*{_UNIT}(?=\s|,|\.|\)|$)",
]
DATE = [
    r"\b[Nn]gày\s+\d{1,2}/\d{1,2}(?:/\d{2,4})?\b", r"\b[Tt]háng\s+\d{1,2}(?:/\d{2,4})?\b", r"\b[Nn]ăm\s+\d{4}\b", r"\b\d{4}-\d{2}-\d{2}\b",
    r"(?<!\w)\d{1,2}/\d{1,2}/\d{2,4}(?!\w)", r"\b[Qq]uý\s+[1-4](?:\s*/\s*\d{4})?\b", r"\b[Qq]uý\s+[IViv]{1,4}(?:\s*/\s*\d{4})?\b", r"\bQ\s*[1-4]\s*/\s*\d{4}\b",
    r"(?i)\bnửa\s+(?:đầu|cuối)\s+(?:năm\s+)?\d{4}\b", r"(?i)\b\d{1,2}\s+tháng\s+(?:đầu|cuối|đầu\s+năm|cuối\s+năm)\s+\d{4}\b", r"(?i)\b(?:6|9|10|11|12)\s+tháng\s+(?:đầu|cuối)\s+năm\s+\d{4}\b",
    r"\b\d{4}\s*[-–]\s*\d{4}\b", r"\b\d{4}\s*/\s*\d{4}\b", YEARS, r"(?i)\b(?:kế\s+hoạch|chiến\s+lược|lộ\s+trình)\s+\d+\s+năm\b",
    r"\b[Tt]hứ\s+(?:[Hh]ai|[Bb]a|[Tt]ư|[Nn]ăm|[Ss]áu|[Bb]ảy|[Cc]hủ\s+nhật)(?:\s+ngày\s+\d{1,2}/\d{1,2}(?:/\d{2,4})?)?\b",
    PART_OF_YEAR, r"(?i)\b(?:năm\s+học|niên\s+học|tài\s+khoá|tài\s+khóa|học\s+kỳ)\s+\d{4}(?:\s*[-–]\s*\d{4})?\b",
]
PERCENT = [
    r"(?<!\w)\d[\d.,]*\s*%(?:/(?:năm|tháng|quý))?(?!\w)", r"(?i)\bâm\s+\d[\d.,]*\s*%(?:/năm)?(?!\w)", r"(?<!\w)[+\-]\s*\d[\d.,]*\s*%(?:/năm)?(?!\w)",
    r"(?<!\w)\d[\d.,]*\s*%?\s*[-–]\s*\d[\d.,]*\s*%(?!\w)", r"(?i)(?<!\w)\d[\d.,]*\s+phần\s+trăm(?!\w)",
    r"(?i)(?:tăng|giảm|đạt|chiếm|lên|xuống|khoảng|ước|thêm|còn|về|vượt|hơn)\s+\d[\d.,]*\s*%(?:/(?:năm|tháng|quý))?",
    r"(?i)(?<!\w)\d[\d.,]*\s+điểm\s*%(?!\w)", r"(?i)(?<!\w)\d[\d.,]*\s+điểm\s+phần\s+trăm(?!\w)",
    r"(?i)(?:xấp\s+xỉ|gần|hơn|dưới|trên|vượt|đạt\s+mức|chỉ|mới)\s+\d[\d.,]*\s*%", r"(?i)\b(?:CAR|NIM|ROA|ROE|NPL|LDR|CIR)\s+\d[\d.,]*\s*%(?!\w)",
]
EVENT = [
    r"\bCOP\s*\d{2}\b", r"(?i)\bSEA\s+Games(?:\s+\d{2,4})?\b", OLYMPIC, r"(?i)\b(?:FIFA\s+)?World\s+Cup(?:\s+\d{4})?\b",
    r"(?i)\b(?:AFF\s+Cup|ASEAN\s+Cup|Asian\s+Cup|Asian\s+Games|ASIAD)(?:\s+\d{4})?\b", r"(?i)\bU\s*\d{2}\s+(?:châu\s+Á|Asian|World\s+Cup|AFF)(?:\s+\d{4})?\b",
    r"(?i)\b(?:Champions\s+League|Europa\s+League)(?:\s+\d{4}(?:-\d{2,4})?)?\b", r"(?i)\bF1\s+(?:Grand\s+Prix|GP)(?:\s+[\w]+)?(?:\s+\d{4})?\b",
    r"(?i)\b(?:WWDC|MWC|CES|Google\s+I/O|Samsung\s+Unpacked|Samsung\s+Galaxy\s+Unpacked|Meta\s+Connect|AWS\s+re:?Invent|Microsoft\s+(?:Ignite|Build)|Qualcomm\s+Summit|Snapdragon\s+Summit|Apple\s+(?:Special\s+)?Event|Apple\s+Worldwide\s+Developers\s+Conference)(?:\s+\d{4})?\b",
    r"(?i)\b(?:Vietnam\s+Mobile\s+Day|Vietnam\s+Internet\s+Day|Vietnam\s+Innovation\s+Summit|Vietnam\s+AI\s+(?:Summit|Day)|Vietnam\s+Fintech\s+(?:Fest|Festival|Forum)|Vietnam\s+(?:Tech|Digital)\s+(?:Summit|Forum|Day)|Vietnam\s+ePayment|Vietnam\s+Blockchain\s+Week|Make\s+in\s+Viet\s+Nam|Make\s+in\s+Vietnam|Techfest\s+Vietnam|Tech\s+Fest\s+Vietnam|ICT\s+Summit\s+Vietnam|Ngày\s+Chuyển\s+đổi\s+số\s+(?:quốc\s+gia)?)(?:\s+\d{4})?\b",
    r"(?i)\b(?:Vietnam\s+(?:Banking|Finance|Financial)\s+(?:Forum|Summit|Outlook|Conference)|Open\s+Banking\s+Forum|Vietnam\s+Fintech\s+Forum|Diễn\s+đàn\s+Fintech\s+Việt\s+Nam|VNBA\s+(?:Annual\s+)?(?:Conference|Forum)|Banking\s+Innovation\s+Summit)(?:\s+\d{4})?\b",
    r"(?i)\bHội\s+nghị\s+(?:Trung\s+ương|TW)\s+(?:lần\s+thứ\s+)?\d+\b", r"(?i)\bĐại\s+hội\s+(?:[Đđ]ảng\s+)?(?:(?:toàn\s+quốc\s+)?lần\s+thứ\s+)?(?:[XIV]+|\d+)\b",
    r"(?i)\bKỳ\s+họp\s+(?:thứ\s+)?\d+(?:\s*,?\s*Quốc\s+hội)?\b", r"(?i)\bHội\s+nghị\s+(?:Chính\s+phủ|toàn\s+quốc)(?:\s+\d{4})?\b",
    AWARD, r"(?i)\b(?:Sao\s+Khuê|VinFuture|Vietnam\s+ICT\s+Awards?|Nhân\s+tài\s+Đất\s+Việt)(?:\s+\d{4})?\b",
    SUMMIT, FAIR,
    r"\b(?:11\.11|12\.12|10\.10|9\.9|8\.8)\b", r"(?i)\b(?:Black\s+Friday|Cyber\s+Monday|Double\s+Day)(?:\s+\d{4})?\b",
    r"(?i)\b(?:APEC|ASEAN\s+Summit|G7|G20|WEF|Davos|RCEP|AIIB)(?:\s+\d{4})?\b", r"(?i)\bDiễn\s+đàn\s+Kinh\s+tế\s+(?:Việt\s+Nam|Thế\s+giới)(?:\s+\d{4})?\b",
    r"(?i)\b(?:COMPUTEX|Gitex|IFA|NAB\s+Show|Interop)(?:\s+\d{4})?\b", r"(?i)\b(?:Shark\s+Tank\s+Việt\s+Nam|Shark\s+Tank\s+Vietnam|Vietnam\s+Expo)(?:\s+\d{4})?\b",
]
PRODUCT = [
    r"\biPhone\s+(?:\d{1,2}(?:\s+(?:Pro(?:\s+Max)?|Plus|Air|Mini))?|Air|SE(?:\s+\d)?)\b", r"\bGalaxy\s+(?:[A-Z]\d{1,2}\+?|Z\s+(?:Fold|Flip)\s*\d|Tab\s+S\d+)\b",
    r"\bPixel\s+\d(?:\s+(?:Pro(?:\s+XL)?|Fold|a))?\b", r"\bmacOS\s+(?:[A-Z][a-z]+|\d{1,2}(?:\.\d+)?)\b", r"\bi(?:OS|PadOS|watchOS|tvOS)\s+\d{1,2}(?:\.\d+)?\b",
    r"\bAndroid\s+\d{1,2}(?:\.\d+)?\b", r"\bSnapdragon\s+(?:\d+\s+Gen\s+\d|X\s+(?:Elite|Plus))\b", r"\b(?:Dimensity|Helio)\s+[A-Z]?\d{2,4}\b",
    r"\bRazr\s+(?:\d{2,4}(?:\s+(?:Ultra|Plus|s))?)\b", r"\bAirPods\s+(?:Pro\s*\d?|\d)\b", r"\bApple\s+Watch\s+(?:Series\s+\d+|Ultra\s*\d?|SE\s*\d?)\b",
]
#: words of which one must be in a text (in lower case) for the pattern to match, and families that need a digit of any script; spares long searches
REQUIRED = {AWARD: ("giải",), SUMMIT: ("summit", "forum", "expo", "conference", "congress", "festival"), FAIR: ("ngày",), OLYMPIC: ("olympic",)}
NUMERIC = frozenset((*MONEY, *PERCENT))
FAMILIES = {"MONEY": MONEY, "DATE": DATE, "PERCENT": PERCENT, "EVENT": EVENT, "PRODUCT": PRODUCT}
# The older, smaller set.
FAMILIES_BASIC = {
    "MONEY": MONEY,
    "DATE": [*DATE[:5], r"\b[Qq]uý\s+[IViv]+/\d{4}\b", PART_OF_YEAR, YEARS],
    "PERCENT": [r"(?<!\w)\d[\d.,]*\s*%(?:/năm)?(?!\w)"],
}

# Industry terms that need a trigger word nearby, and the triggers.
INDUSTRY_NEEDS_CONTEXT = (
    "công nghệ", "game", "y tế", "giáo dục", "du lịch", "ngân hàng", "tài chính", "logistics", "vận tải", "nông nghiệp", "công nghiệp",
    "xây dựng", "năng lượng", "dầu khí", "bảo hiểm", "điện ảnh", "thời trang", "ẩm thực", "chứng khoán", "hàng không", "viễn thông",
)
INDUSTRY_TRIGGERS = ("ngành", "lĩnh vực", "thị trường", "thị phần", "sector", "công nghiệp", "ngành hàng", "phân khúc", "hệ sinh thái")
# Order in which dictionary types win over one another at equal length.
DICTIONARY_ORDER = ("PRODUCT", "EVENT", "INDUSTRY", "ORGANIZATION", "LOCATION", "PERSON")
# Dictionaries of moderate size by type; events and further names come in as a table.
DICTIONARIES = {
    "PRODUCT": (
        "AirPods", "HomePod", "HomeHub", "Apple Watch", "Razr", "5G Advanced", "5G SA", "5G NSA", "LTE Advanced", "MIMO", "Snapdragon", "MediaTek", "Apple M3", "Apple M4",
        "ChatGPT", "Gemini", "Siri", "Alexa", "Copilot", "Claude", "DeepSeek", "Llama", "Mistral", "Apple Intelligence", "Apple Foundation Models", "Google Gemini",
        "Microsoft Copilot", "App Store", "Google Play", "Open Banking", "OneBank", "OneBank 365+", "CheckVN", "VDAPES", "vTravel", "ZaloPay", "MoMo", "VNPay", "VietQR",
        "Shopee", "Lazada", "Tiki", "TikTok Shop",
    ),
    "INDUSTRY": (
        "nông nghiệp công nghệ cao", "thương mại điện tử xuyên biên giới", "công nghiệp bán dẫn", "công nghiệp game", "ngành game", "phòng cháy chữa cháy",
        "năng lượng tái tạo", "năng lượng sạch", "trí tuệ nhân tạo", "chuyển đổi số", "kinh tế số", "bất động sản", "ngân hàng", "tài chính", "chứng khoán", "công nghệ",
        "viễn thông", "thương mại điện tử", "du lịch", "hàng không", "logistics", "vận tải", "nông nghiệp", "công nghiệp", "y tế", "giáo dục", "xây dựng", "năng lượng",
        "dầu khí", "bảo hiểm", "game", "điện ảnh", "thời trang", "ẩm thực",
    ),
    "ORGANIZATION": (
        "BIDV", "ACB", "SHB", "OCB", "MSB", "VIB", "NCB", "KLB", "HDBank", "LPBank", "TPBank", "VPBank", "ABBank", "BVBank", "SeABank", "PGBank", "VietBank", "Saigonbank",
        "KienlongBank", "Bac A Bank", "Viet A Bank", "Nam A Bank", "HoSE", "HNX", "UPCOM", "NAPAS", "NHNN", "UBND", "Viettel", "VNPT", "FPT", "VNG", "MoMo", "ZaloPay",
        "VinAI", "VinBigData", "Tiki", "Sendo", "VTC", "VTC Pay", "VNPT VinaPhone", "SECO", "WHO", "UNESCO", "ASEAN", "EU", "NATO", "IMF", "WTO", "APEC", "3GPP", "GSMA",
        "Nvidia", "TSMC", "Qualcomm", "ARM", "MediaTek", "ByteDance", "Tencent", "Alibaba", "Baidu", "Huawei", "OpenAI", "Anthropic", "Mistral AI", "DeepSeek",
        "Finance Suisse", "Palmer Johnson", "Bloomberg Intelligence", "Sensor Tower", "Statista", "LightReading", "The Verge", "HR Asia", "IDC", "Gartner", "Forrester",
        "Cục Thương mại Điện tử và Kinh tế số", "Cục Quản lý và Phát triển thị trường trong nước", "Cục Công nghiệp CNTT", "Đại học Bách Khoa Hà Nội",
        "Tổng cục Kinh tế Liên bang Thụy Sĩ", "Phát Đạt Corporation",
    ),
    "LOCATION": (
        "Đông Nam Á", "Châu Á", "Tây Bắc", "Đông Bắc", "Trung Đông", "Thung lũng Silicon", "Silicon Valley", "Biển Đông", "Hoàng Sa", "Trường Sa",
        "Khu công nghệ cao Hòa Lạc", "KCN VSIP", "chợ đầu mối Bình Điền", "TP.HCM", "TP HCM",
    ),
    "PERSON": (
        "Mark Zuckerberg", "Zuckerberg", "Steve Jobs", "Tim Cook", "Elon Musk", "Jeff Bezos", "Sundar Pichai", "Andy Jassy", "Børje Ekholm", "Dan Ives", "Sam Altman",
        "Satya Nadella", "Jensen Huang", "Joe Rogan", "Rogan", "Tomasz Noetzel", "Tse King Kiu", "Park Hang Seo", "Park Hang-seo",
    ),
}

# Label corrections of single tokens (type, whether an unlabelled token gets it too).
TOKEN_FIXES = {
    **{t: ("PRODUCT", True) for t in ("ChatGPT", "iPhone", "iPad", "MacBook", "iMac", "iPod", "AirPods", "HomePod", "iOS", "macOS", "Siri", "Copilot", "Pepero", "Razr", "Snapdragon", "MediaTek")},
    **{t: ("PRODUCT", False) for t in ("Galaxy", "Pixel", "Gemini", "Alexa", "Claude", "DeepSeek", "Llama")},
    **{t: ("ORGANIZATION", False) for t in ("OpenAI", "Viettel", "VIB", "VPBank")},
    **{t: ("EVENT", False) for t in ("WWDC", "Olympic", "MWC", "CES")},
}
# Label corrections of token sequences, applied in this order (None: no label).
SEQUENCE_FIXES = (
    (("tỷ", "phú"), None, False), (("triệu", "phú"), None, False),
    (("MacBook", "Pro"), "PRODUCT", True), (("MacBook", "Air"), "PRODUCT", True), (("Apple", "Watch"), "PRODUCT", True), (("Apple", "TV"), "PRODUCT", True),
    (("Apple", "M3"), "PRODUCT", True), (("Apple", "M4"), "PRODUCT", True), (("Google", "Pixel"), "PRODUCT", True),
    (("SEA", "Games"), "EVENT", True), (("Google", "I/O"), "EVENT", True),
)
# Tokens with a slash or mark that stay whole.
UNSPLIT_TOKENS = ("TP.HCM", "tp.hcm", "TP/HN", "tp/hn", "km/h", "m/s", "km/s", "USD/VND", "VND/USD", "R&D", "B2B", "B2C", "P2P")

# Relation patterns (name, pattern, subject types, object types, confidence, both directions).
_CAP = "[A-ZÀÁÂÃÈÉÊÌÍÒÓÔÕÙÚĂĐ]"
_ORG = rf"({_CAP}[\w\s&]{{2,50}}?)"
RELATIONS = (
    ("LÃNH_ĐẠO", rf"({_CAP}[\w\s]{{2,40}}?)\s*[,–\-]?\s*(?:Chủ\s+tịch|Tổng\s+giám\s+đốc|Giám\s+đốc|CEO|CFO|CTO|COO|Phó\s+chủ\s+tịch|Phó\s+tổng\s+giám\s+đốc|Chủ\s+tịch\s+HĐQT|Trưởng\s+ban|Giám\s+đốc\s+điều\s+hành)\s+(?:của\s+|tại\s+)?({_CAP}[\w\s&,\.]{{2,50}})", ("PERSON",), ("ORGANIZATION",), 0.85, False),
    ("HỢP_TÁC", rf"{_ORG}\s+(?:hợp\s+tác|ký\s+kết|bắt\s+tay|liên\s+kết|phối\s+hợp|hợp\s+tác\s+chiến\s+lược|ký\s+biên\s+bản\s+ghi\s+nhớ)\s+(?:cùng\s+|với\s+)?({_CAP}[\w\s&]{{2,50}})", ("ORGANIZATION",), ("ORGANIZATION",), 0.80, True),
    ("ĐẦU_TƯ", rf"{_ORG}\s+(?:đầu\s+tư|rót\s+vốn|rót|góp\s+vốn|mua\s+cổ\s+phần|mua\s+lại|thâu\s+tóm|mua\s+cổ\s+phiếu)\s+(?:vào\s+|cho\s+)?({_CAP}[\w\s&]{{2,50}})", ("ORGANIZATION", "PERSON"), ("ORGANIZATION",), 0.82, False),
    ("SẢN_XUẤT", rf"{_ORG}\s+(?:ra\s+mắt|sản\s+xuất|phát\s+triển|tung\s+ra|giới\s+thiệu|công\s+bố|phát\s+hành|trình\s+làng|chính\s+thức\s+ra\s+mắt|cho\s+ra\s+mắt)\s+({_CAP}[\w\s\d\.\-]{{1,40}})", ("ORGANIZATION",), ("PRODUCT",), 0.78, False),
    ("ĐẶT_TẠI", rf"{_ORG}\s+(?:đặt\s+tại|có\s+trụ\s+sở\s+tại|hoạt\s+động\s+tại|đặt\s+trụ\s+sở|thành\s+lập\s+tại|khai\s+trương\s+tại|mở\s+rộng\s+tại|có\s+văn\s+phòng\s+tại)\s+({_CAP}[\w\s,\.]{{2,40}})", ("ORGANIZATION",), ("LOCATION",), 0.75, False),
    ("THUỘC_NGÀNH", rf"{_ORG}\s+(?:thuộc\s+lĩnh\s+vực|hoạt\s+động\s+trong|chuyên\s+về|trong\s+ngành|lĩnh\s+vực|ngành)\s+([\w\s]{{2,40}})", ("ORGANIZATION",), ("INDUSTRY",), 0.72, False),
    ("TỔ_CHỨC_SỰ_KIỆN", rf"{_ORG}\s+(?:tổ\s+chức|đăng\s+cai|chủ\s+trì|đứng\s+ra\s+tổ\s+chức|khởi\s+động|phát\s+động)\s+({_CAP}[\w\s\d\-\.]{{2,60}})", ("ORGANIZATION",), ("EVENT",), 0.78, False),
    ("CÓ_GIÁ_TRỊ", rf"{_ORG}\s+(?:trị\s+giá|có\s+giá\s+trị|đạt|giá\s+trị\s+khoảng|ước\s+tính)\s+(\d[\d.,]*\s*(?:triệu|tỷ|nghìn|ngàn)?\s*(?:USD|VND|VNĐ|đồng|đô)?)", None, None, 0.75, False),
    ("XẢY_RA_TẠI", rf"({_CAP}[\w\s\d\-]{{2,60}}?)\s+(?:diễn\s+ra\s+tại|tổ\s+chức\s+tại|xảy\s+ra\s+tại|được\s+tổ\s+chức\s+tại|khai\s+mạc\s+tại|diễn\s+ra)\s+({_CAP}[\w\s,\.]{{2,40}})", ("EVENT",), ("LOCATION",), 0.76, False),
    ("THAM_GIA", rf"({_CAP}[\w\s]{{2,40}}?)\s+(?:tham\s+gia|tham\s+dự|xuất\s+hiện\s+tại|có\s+mặt\s+tại|phát\s+biểu\s+tại)\s+({_CAP}[\w\s\d\-]{{2,60}})", ("PERSON",), ("EVENT",), 0.73, False),
    ("TĂNG_TRƯỞNG", rf"{_ORG}\s+(?:tăng\s+trưởng|tăng|đạt|ghi\s+nhận|tăng\s+lên)\s+(\d[\d.,]*\s*%(?:/năm)?)", None, None, 0.70, False),
)
CO_OCCURRENCE = "LIÊN_QUAN"
CO_PAIRS = ((("ORGANIZATION",), ("ORGANIZATION",)), (("PERSON",), ("ORGANIZATION",)), (("ORGANIZATION",), ("LOCATION",)))
