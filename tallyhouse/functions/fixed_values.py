"""Fixed values.

These must equal the shop's own values for results to be right; they are
listed plainly and together here and used nowhere as anything but data.
"""

# Category code -> label.
CATEGORY_LABELS = {
    "excel": "엑셀 프로그램",
    "sheets": "구글시트 자동화",
    "short": "숏폼 템플릿",
    "detail": "상세페이지 제작",
    "web": "홈페이지 제작",
    "program": "프로그램 제작",
}

# Support inquiry code -> label.
INQUIRY_LABELS = {
    "refund": "결제/환불",
    "file": "파일 다운로드",
    "usage": "사용 방법",
    "custom": "맞춤제작 견적",
    "etc": "기타",
}

# Choice on the inquiry form -> inquiry code.
INQUIRY_CODES = {
    "주문 / 결제 문의": "refund",
    "상품 이용 문의": "usage",
    "환불 / 취소 문의": "refund",
    "오류 / 버그 신고": "etc",
    "맞춤 제작 문의": "custom",
    "기타": "etc",
}

# Header and cell texts of the catalog CSV.
CSV_HEADER = ["ID", "상품명", "카테고리", "판매가", "할인가", "판매유형", "노출", "등록일"]
CSV_SALE_FILE = "파일판매"
CSV_SALE_INQUIRY = "문의형"

# Order statuses that count as settled, with and without refunds.
VALID_STATUSES = ["paid", "sent", "done", "resend"]
REFUND_STATUSES = ["refund", "refunded"]
SETTLED_STATUSES = VALID_STATUSES + REFUND_STATUSES

# Grades in ascending order, and the ones only an admin sets.
GRADES = ["new", "sprout", "regular", "vip", "vvip"]
MANUAL_GRADES = GRADES + ["blacklist"]

# Default monthly upper limits of the grades, in won.
SPROUT_MAX = 50_000
REGULAR_MAX = 300_000
VIP_MAX = 1_000_000

# Won per US dollar, points for a review, catalog defaults.
WON_PER_USD = 1350
REVIEW_POINTS = 500
DEFAULT_SALE_TYPE = "file"
DEFAULT_EMOJI = "📦"
ANONYMOUS_NAME = "익명"
DEFAULT_PROVIDER = "portone"

# Rate limit as (requests, window).
LOGIN_LIMIT = (10, "15 minutes")

# Login id format.
LOGIN_ID_PATTERN = "^[a-zA-Z][a-zA-Z0-9]{2,19}$"
