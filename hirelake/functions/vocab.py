"""Vocabularies and constants.

FIXED VALUES — these must equal the behaviour being reproduced (codes, limits, word
lists, synonym maps).  They are kept here, in natural order, in one place.  Order
matters wherever a list is scanned "first hit wins".
"""

# ---------------------------------------------------------------- FIXED VALUES
SALARY_MIN = 600          # unit: 10k KRW per year
SALARY_MAX = 50000
EXPERIENCE_MAX = 30       # years
OPEN_DEADLINE = "9999-12-31"
OPEN_DEADLINE_DISPLAY_FROM = "9999-01-01"

# employment type codes (id, name)
EMPLOYMENT_TYPES = [
    (1, "정규직"), (2, "계약직"), (3, "인턴"), (4, "파견직"), (5, "프리랜서"),
    (6, "위촉직"), (7, "도급"), (8, "연수생"), (9, "병역특례"), (10, "아르바이트"),
]

# education: exact text -> level
EDUCATION_LEVELS = [
    ("학력무관", 0), ("고졸↑", 1), ("초대졸↑", 2), ("대졸↑", 3), ("석사↑", 4), ("박사↑", 5),
]

# employment type parsing: substring -> code, scanned in this order
FORM_PATTERNS = [
    ("정규직", 1), ("계약직", 2), ("인턴", 3), ("파견직", 4), ("프리랜서", 5),
    ("위촉직", 6), ("개인사업자", 6), ("도급", 7), ("연수생", 8), ("교육생", 8),
    ("병역특례", 9), ("아르바이트", 10),
]

# a location text containing one of these is an employment type, not a region
REGION_BLOCKERS = ["정규직", "계약직", "인턴", "파견직", "프리랜서"]
REGION_SUFFIX_DROP = "외"

EXPERIENCE_ZERO_MARKERS = ["신입", "경력무관"]

# tag synonyms applied to description tags (exact, case-sensitive)
TAG_SYNONYMS = [
    ("JAVA", "Java"),
    ("SPRING", "Spring"),
    ("vue.js", "Vue.js"),
    ("vuejs", "Vue.js"),
    ("Vue", "Vue.js"),
    ("springboot", "Spring Boot"),
    ("spring Framework개발", "Spring"),
    ("React 기반", "React"),
    ("Backend", "백엔드"),
    ("Front-end 개발", "프론트엔드"),
]

# query understanding
REGIONS = [
    "서울", "경기", "인천", "부산", "대구", "광주", "대전", "울산", "세종",
    "강원", "충북", "충남", "전북", "전남", "경북", "경남", "제주",
]
FORM_KEYWORDS = ["정규직", "계약직", "인턴", "파견직", "프리랜서", "아르바이트"]
STOPWORDS = [
    "공고", "채용", "보여줘", "찾아줘", "알려줘", "검색해줘", "검색", "추천",
    "이상", "이하", "까지", "에서", "부터", "으로", "에서의", "로서",
    "좀", "주세요", "해줘", "해주세요", "연봉", "경력",
    "모집하는", "모집", "마감",
    "일할", "수", "있는", "있어", "원하는", "하는", "하고", "싶은", "싶어",
    "찾는", "구하는", "되는", "위한", "관련", "관한",
]
QUERY_SYNONYMS = [
    ("FE", "프론트엔드"),
    ("BE", "백엔드"),
    ("frontend", "프론트엔드"),
    ("backend", "백엔드"),
    ("fullstack", "풀스택"),
    ("devops", "DevOps"),
    ("데이터분석가", "데이터 분석"),
    ("데이터사이언티스트", "데이터 분석"),
    ("데이터과학자", "데이터 분석"),
    ("개발직", "개발자"),
    ("기획자", "서비스기획"),
    ("퍼블리셔", "UI퍼블리셔"),
]
JOB_KEYWORDS = [
    "개발", "개발자", "백엔드", "프론트엔드", "풀스택",
    "디자이너", "디자인", "UI", "UX",
    "마케팅", "마케터",
    "영업", "영업직",
    "회계", "재무", "경리",
    "고객응대", "고객서비스", "CS",
    "물류", "유통", "배송",
    "데이터", "데이터분석",
    "기획", "PM", "PO",
    "HR", "인사", "총무",
    "연구", "연구원",
    "생산", "제조", "품질",
    "교육", "강사",
]
COMPANY_TRIGGER_WORDS = ["공고", "채용"]
EXPERIENCE_WORDS = ["신입", "경력"]

# search / alerts
FALLBACK_MIN_WITH_TAGS = 3
FALLBACK_MIN_NAME_ONLY = 1
ADAPTIVE_THRESHOLD = 3
ADAPTIVE_POOL_MIN = 50
ADAPTIVE_POOL_FACTOR = 5
MAX_SUBSCRIPTIONS_PER_USER = 5
ALERT_SHOW = 10
RERANK_BATCH = 10
RERANK_TAGS_SHOWN = 5
RERANK_DEFAULT_SCORE = 5.0
MODEL_TOKEN_MAX_LEN = 20
TAG_BATCH = 100

# display texts
DISPLAY_OPEN = "상시채용"
DISPLAY_DUE = ["오늘마감", "내일마감", "모레마감"]   # due in 0 / 1 / 2 days
DISPLAY_SALARY_NEGOTIABLE = "협의"
DISPLAY_SALARY_UNIT = "만원/년"
DISPLAY_EXPERIENCE_ANY = "경력무관"
DISPLAY_EXPERIENCE_NEW = "신입"
DISPLAY_EXPERIENCE_YEARS = "년 이상"
DISPLAY_EDUCATION_OTHER = "기타"
DISPLAY_FORM_MISSING = "정보 없음"
DISPLAY_PROFILE_ANY = "상관없음"

# posting card lines (label prefixes)
CARD_HEAD = "📌"
CARD_LINK = "🔗"
CARD_EXPERIENCE = "- 경력: "
CARD_EDUCATION = "- 학력: "
CARD_FORM = "- 형태: "
CARD_SALARY = "- 연봉: "
CARD_DEADLINE = "- 마감일: "

# crawl recency texts
RECENT_MINUTES = "분 전 등록"
RECENT_HOURS = "시간 전 등록"

# market analytics experience labels (null, 0, <=3, <=7, else)
MARKET_EXPERIENCE_LABELS = ["경력무관", "신입", "1~3년", "4~7년", "8년 이상"]
# quality report experience bands (0, 1..3, 4..7, >=8)
QUALITY_EXPERIENCE_BANDS = ["신입", "1~3년", "4~7년", "8년 이상"]

RULE_BELOW_MIN = f"below_minimum({SALARY_MIN})"
RULE_ABOVE_MAX_SALARY = f"above_maximum({SALARY_MAX})"
RULE_NEGATIVE = "negative_value"
RULE_ABOVE_MAX_EXPERIENCE = f"above_maximum({EXPERIENCE_MAX})"
# ------------------------------------------------------------ END FIXED VALUES
