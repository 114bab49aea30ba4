"""Rule tables, word lists, thresholds and default texts.

They are data, not logic: results only agree with other users of the same rules
if these are the same, so they are written out plainly and in their given order.
"""

# Collection -------------------------------------------------

MACRO_KEYWORDS = [
    "Fed", "Federal Reserve", "FOMC", "Powell", "rate",
    "inflation", "CPI", "PCE", "GDP", "unemployment", "jobs",
    "tariff", "trade", "sanctions", "oil", "OPEC",
    "earnings", "revenue", "guidance", "recession",
    "yield", "treasury", "dollar", "currency",
    "China", "Europe", "ECB", "BOJ", "central bank",
]
API_SOURCE_WHITELIST = [
    "Reuters", "Bloomberg", "Financial Times", "The Wall Street Journal",
    "CNBC", "MarketWatch", "Associated Press", "AP News",
]
FEED_SOURCES = [("reuters", "Reuters"), ("nytimes", "New York Times"), ("bloomberg", "Bloomberg")]
UNKNOWN_SOURCE = "Unknown"
FRESH_HOURS = 24
DESCRIPTION_CHARS = 500
CATEGORY_LIMIT = 100
TITLE_RATIO = 0.9

# Clustering -------------------------------------------------

TITLE_WEIGHT = 10
BODY_CHARS = 600
WORD_MAX_FEATURES = 5000
WORD_MAX_DF = 0.85
CHAR_MAX_FEATURES = 1500
CHAR_MAX_DF = 0.95
MERGE_COSINE = 0.85
LABEL_CHARS = 50
NOISE_LABEL = "노이즈"
COMMON_WORDS = [
    "the", "and", "for", "are", "from", "with", "that", "this", "said", "says",
    "will", "has", "have", "been", "about", "after", "could", "would", "should",
    "news", "reuters", "bloomberg", "cnbc", "report", "reports", "reported",
    "의원", "기자", "대통령", "정부", "국회", "당", "시", "군", "도", "구", "면", "동",
    "위원", "위원장", "의회", "의장", "정치", "뉴스", "오늘", "사실", "관련", "발표",
    "대표", "청와대", "여야", "야당", "여당", "국민", "우리", "조사",
]

# Record validation ------------------------------------------

SECTORS = [
    "정유업종", "항공사들", "해운업체", "반도체 기업", "방산업체", "화학업종",
    "자동차 제조사", "은행·금융", "보험", "바이오·제약", "건설업종", "유통·소비재",
    "전력·설비", "철강·소재", "엔터·미디어", "IT·플랫폼", "여행·레저",
]
# lower-case text to look for -> name to show, first hit wins
OUTLETS = [
    ("reuters", "Reuters"), ("bloomberg", "Bloomberg"), ("cnbc", "CNBC"),
    ("financial times", "Financial Times"), ("wall street journal", "Wall Street Journal"),
    ("marketwatch", "MarketWatch"), ("ap", "AP"), ("new york times", "New York Times"),
    ("nyt", "NYT"), ("wsj", "WSJ"), ("ft", "FT"),
]
DEFAULT_SOURCES = ["Reuters"]
MAX_SOURCES = 3
BANNED_PHRASES = [
    "예상된다", "예상됩니다", "전망이다", "전망입니다", "전망된다",
    "오를 것", "떨어질 것", "상승할 것", "하락할 것",
    "추천", "매수", "매도", "사야", "팔아야", "유망하다",
]
REASON_SIGNATURES = [
    ("은행·금융", ["예대마진", "순이자마진", "대출금리", "수신금리", "예대 마진"]),
    ("보험", ["보험", "운용자산", "보험금", "역마진", "공시이율"]),
    ("바이오·제약", ["임상", "신약", "제약", "바이오"]),
    ("정유업종", ["정제마진", "정제 마진", "정유"]),
    ("항공사들", ["항공유", "여객", "항공권", "항공"]),
    ("해운업체", ["운임", "해운", "선사", "해상운송", "해상 운송"]),
    ("방산업체", ["방산", "국방예산", "국방 예산", "무기"]),
    ("반도체 기업", ["파운드리", "메모리", "반도체"]),
    ("건설업종", ["분양", "시공", "수주잔고", "건설"]),
    ("자동차 제조사", ["완성차", "자동차"]),
    ("화학업종", ["납사", "석유화학"]),
    ("철강·소재", ["철강", "철광석"]),
    ("전력·설비", ["송전", "변압기", "전력망"]),
    ("엔터·미디어", ["콘텐츠", "엔터"]),
    ("IT·플랫폼", ["플랫폼", "클라우드", "소프트웨어"]),
    ("여행·레저", ["여행", "관광", "레저"]),
]
TOKEN_PATTERN = "[가-힣A-Za-z0-9.%]+"
DUPLICATE_JACCARD = 0.6
DEFAULT_HOOK = "오늘의 글로벌\n경제 시그널"
DEFAULT_ONE_LINE = "주요 외신이 보도한 글로벌 매크로 이슈를 시그널로 정리했습니다."
MIN_FACTS, MIN_SECTORS, MIN_SUMMARIES = 2, 1, 2
BENEFIT_SIDE, CAUTION_SIDE = "수혜", "주의"
DEFAULT_REASON = "이번 이슈의 직접 영향권에 있는 업종이다."
MARKET_DISCLAIMER = "※ 현재 시장 지표가 엇갈리고 있어 실제 반응은 다를 수 있습니다."

# Macro rules ------------------------------------------------
# topic, price series, expected direction, sectors that gain, sectors that lose
MACRO_RULES = [
    ("유가 상승", "CL=F", "up", ["에너지", "조선", "자본재", "방위산업"], ["운송", "유틸리티", "항공"]),
    ("유가 하락", "CL=F", "down", ["운송", "유틸리티", "항공"], ["에너지", "조선", "정유"]),
    ("금리 인상", "^TNX", "up", ["은행", "보험", "금융"], ["제약", "바이오", "건설", "소프트웨어"]),
    ("금리 인하", "^TNX", "down", ["제약", "바이오", "소프트웨어", "건설"], ["은행", "보험"]),
    ("달러 강세", "KRW=X", "up", ["자동차", "반도체", "IT"], ["항공", "음식료", "철강"]),
    ("달러 약세", "KRW=X", "down", ["항공", "음식료", "유통"], ["자동차", "반도체", "IT"]),
    ("지정학 리스크", "CL=F", "up", ["방위산업", "해운", "에너지"], ["여행", "항공", "소비재"]),
    ("지정학 해소", "CL=F", "down", ["여행", "항공", "소비재"], ["방위산업", "해운", "정유"]),
    ("중국 경기 호조", "000001.SS", "up", ["철강", "화학", "화장품", "엔터"], []),
    ("AI 반도체", "^IXIC", "up", ["반도체", "IT", "전력설비"], []),
    ("국방비 증가", "ITA", "up", ["방위산업", "IT"], []),
]
SECTOR_ALIASES = [
    ("은행·금융", ["은행", "금융"]),
    ("보험", ["보험"]),
    ("바이오·제약", ["바이오", "제약"]),
    ("건설업종", ["건설"]),
    ("정유업종", ["정유", "에너지"]),
    ("항공사들", ["항공"]),
    ("해운업체", ["해운", "운송"]),
    ("방산업체", ["방위산업"]),
    ("반도체 기업", ["반도체"]),
    ("IT·플랫폼", ["IT", "소프트웨어"]),
    ("유통·소비재", ["유통", "소비재"]),
    ("여행·레저", ["여행"]),
    ("화학업종", ["화학"]),
    ("자동차 제조사", ["자동차"]),
    ("전력·설비", ["전력설비", "유틸리티"]),
    ("철강·소재", ["철강"]),
    ("엔터·미디어", ["엔터"]),
]
# topic -> lower-case words, first hit wins; AI_WORD counts only as a whole word
TOPIC_WORDS = [
    ("지정학 해소", ["iran", "이란", "ceasefire", "휴전", "협상"]),
    ("지정학 리스크", ["war", "conflict", "missile", "전쟁"]),
    ("국방비 증가", ["defense spending", "defense budget", "military spending", "국방비", "방위비"]),
    ("유가 상승", ["oil rise", "opec cut", "유가 상승"]),
    ("유가 하락", ["oil fall", "oil drop", "유가 하락"]),
    ("금리 인상", ["rate hike", "금리 인상", "tightening"]),
    ("금리 인하", ["rate cut", "금리 인하", "pivot"]),
    ("달러 강세", ["dollar strong", "달러 강세"]),
    ("AI 반도체", ["semiconductor", "반도체", "nvidia", "인공지능"]),
]
AI_TOPIC, AI_WORD = "AI 반도체", "ai"
TREND_DAYS = 5
TREND_TOLERANCE = 0.5

# Cover pictures ---------------------------------------------

COVER_PHRASES = [
    ("iran", "diplomacy handshake suit"),
    ("이란", "diplomacy handshake suit"),
    ("ceasefire", "bright sunrise city skyline"),
    ("휴전", "diplomacy handshake global"),
    ("war", "stormy dark clouds sky"),
    ("conflict", "stormy dark clouds sky"),
    ("지정학", "stormy dark clouds city"),
    ("oil rise", "oil refinery sunset pump jack"),
    ("oil fall", "calm ocean aerial clear sky"),
    ("유가 상승", "oil refinery sunset dark"),
    ("유가 하락", "calm ocean aerial green"),
    ("opec", "oil refinery sunset"),
    ("energy", "oil refinery sunset silhouette"),
    ("연준", "federal reserve building washington"),
    ("fomc", "federal reserve building washington"),
    ("fed", "federal reserve building washington"),
    ("rate hike", "skyscraper bank building night city"),
    ("rate cut", "coins money growth green"),
    ("금리 인상", "skyscraper bank building night city"),
    ("금리 인하", "coins money growth green"),
    ("inflation", "business graph falling red"),
    ("dollar", "stack coins international container ship"),
    ("환율", "container ship port daytime"),
    ("trade", "global trade shipping cargo"),
    ("tariff", "container ship cargo port"),
    ("관세", "cargo container ship port"),
    ("nasdaq", "stock market trading finance blue"),
    ("market", "stock market trading finance"),
    ("kospi", "korea stock exchange finance"),
    ("recession", "business graph falling red dark"),
    ("ai", "glowing microchip blue server room"),
    ("semiconductor", "glowing microchip blue neural network"),
    ("반도체", "microchip technology server room lights"),
    ("nvidia", "gpu chip technology blue"),
    ("china", "bustling asian market neon city"),
    ("중국", "neon city street crowd colorful"),
    ("defense", "military technology aerospace"),
    ("방산", "aerospace technology defense"),
]
DEFAULT_COVER = "global economy finance business city"
TOPIC_COVERS = [
    ("유가 상승", "oil refinery sunset pump jack"),
    ("유가 하락", "calm ocean aerial clear sky"),
    ("금리 인상", "skyscraper bank building night city"),
    ("금리 인하", "coins money growth green"),
    ("달러 강세", "us dollar bills money stack"),
    ("달러 약세", "currency exchange money global"),
    ("지정학 리스크", "stormy dark clouds sky"),
    ("지정학 해소", "bright sunrise city skyline"),
    ("중국 경기 호조", "shanghai skyline night city"),
    ("AI 반도체", "glowing microchip blue server room"),
    ("국방비 증가", "aircraft carrier navy ship"),
]
BAD_TAGS = [
    "panorama", "panoramic", "360", "fisheye", "fish eye", "planet",
    "sphere", "abstract", "cartoon", "illustration", "drawing", "render",
    "collage", "wallpaper", "map", "flag", "logo", "halloween", "christmas",
]
BAD_TAG_POINTS, BAD_ASPECT_POINTS, WORD_POINTS = -100.0, -50.0, 20.0
MAX_ASPECT, MIN_ASPECT = 2.2, 0.4
DOWNLOADS_PER_POINT, MAX_DOWNLOAD_POINTS = 10000.0, 10.0
MIN_QUERY_WORD = 4
REJECT_SCORE = -50.0

# Script text and cache key ----------------------------------

CACHE_MODEL, CACHE_VERSION, CACHE_KEY_CHARS = "gemini-2.5-flash", "s44.1", 32
MATERIAL_ARTICLES, MATERIAL_SUMMARY_CHARS = 5, 400
MATERIAL_LABEL_LINE, MATERIAL_LIST_LINE = "[클러스터 라벨] ", "[기사 목록]"
HOOK_HEADER = "[벤치마크에서 검증된 훅 패턴 — 아래 패턴 중 하나를 골라 변주하라]"
MAX_HOOK_PATTERNS = 6
SOURCE_PREFIX, SOURCE_JOIN = "출처 · ", " · "
NUMBER_PATTERN = r"\d[\d,]*\.?\d*\s*(?:%|p|원|달러|배럴|억|만|조|bp|개월|년|포인트)?"

GENERIC_SCRIPT = {
    "hook_title": DEFAULT_HOOK,
    "one_line": DEFAULT_ONE_LINE,
    "sources": ["Reuters"],
    "image_keyword": DEFAULT_COVER,
    "slide2_facts": [
        "주요 외신이 글로벌 매크로 이슈를 일제히 보도하며 시장의 관심이 집중됐다.",
        "관련 지표와 시장 가격이 함께 움직이며 변동성이 커졌다.",
    ],
    "slide2_source": "출처 · Reuters",
    "slide3_sectors": [("은행·금융", "거래 변동성이 커질 때 중개·운용 수익 기반이 넓어졌다.")],
    "slide3_fact": "",
    "slide4_sectors": [("유통·소비재", "대외 불확실성이 커지면 소비 심리가 위축되는 흐름이 나타났다.")],
    "slide4_fact": "",
    "slide5_summaries": [
        "글로벌 매크로 이슈가 시장 변동성을 키웠다.",
        "업종별로 영향의 방향이 갈리는 모습이 관찰됐다.",
    ],
    "slide5_watch_point": "후속 보도와 주요 지표 발표 일정.",
}
# cluster id -> hand-written script
CURATED_SCRIPTS = {
    "6": {
        "hook_title": "물가 다시\n오를까?",
        "one_line": "미국 연준 위원 다수, 물가 상승 위험에 금리 인상 가능성 언급하며 긴축 기조 재확인.",
        "sources": ["Reuters"],
        "image_keyword": "federal reserve building washington",
        "slide2_facts": [
            "미국 연준 위원 다수가 물가 상승 위험을 이유로 현재 금리 5.50% 수준에서 추가 인상 가능성을 언급하며 긴축 기조를 재확인했다.",
            "유로존 5월 소비자물가 상승률은 2.8%로 전월 2.6%에서 반등했다.",
            "미국 셰일 유정 완결 대기 물량은 약 4,150개로 사상 최저 수준까지 줄었다.",
        ],
        "slide2_source": "출처 · Reuters",
        "slide3_sectors": [
            ("은행·금융", "금리 인상 기조가 이어지며 예대마진이 0.2%p 개선됐다."),
            ("보험", "시장 금리가 5.50%로 오르며 신규 운용자산 수익률이 높아졌다."),
        ],
        "slide3_fact": "유로존 물가가 2.8%로 반등하면서 고금리 환경이 길어질 가능성이 커졌다.",
        "slide4_sectors": [
            ("건설업종", "조달 금리가 5.50%까지 오르며 프로젝트 이자 부담이 커졌다."),
            ("유통·소비재", "고금리 장기화로 가계 이자 부담이 늘며 소비 여력이 줄었다."),
        ],
        "slide4_fact": "셰일 완결 대기 유정이 4,150개로 줄어 공급 측 유가 부담이 이어졌다.",
        "slide5_summaries": [
            "연준의 긴축 재확인과 유로존 물가 반등이 겹치며 고금리 국면이 길어질 조건이 쌓였다.",
            "금리 수혜 업종(은행·보험)과 부담 업종(건설·소비재)의 온도 차가 뚜렷해졌다.",
            "셰일 공급 여력 축소는 유가를 떠받쳐 물가 부담을 더하는 요인으로 꼽혔다.",
        ],
        "slide5_watch_point": "다음 FOMC 금리 결정과 유로존 물가 2.8% 흐름의 지속 여부.",
    },
}

# Discovery --------------------------------------------------

TOP_POSTS = 5
MAX_POSTS = 50
POST_URL_PREFIX, POST_URL_SUFFIX = "https://www.instagram.com/p/", "/"
VIDEO_URL_PREFIX = "https://www.youtube.com/watch?v="
POST_ID_PATTERN = (
    r"(?:instagram\.com/(?:p|reel)/|youtube\.com/(?:shorts/|watch\?v=)|youtu\.be/)([\w-]+)"
)
SLUG_CHARS = 30
