"""Results depend on these exact lists, patterns and numbers."""

# --- search terms -----------------------------------------------------------

# (canonical name, alias, type, language, boost), in dictionary order
ALIASES = [
    ("milestone", "milestone", "business", "en", 1.15),
    ("milestone", "마일스톤", "business", "ko", 1.15),
    ("upfront", "upfront", "business", "en", 1.15),
    ("upfront", "계약금", "business", "ko", 1.15),
    ("term sheet", "term sheet", "business", "en", 1.1),
    ("term sheet", "텀싯", "business", "ko", 1.1),
    ("preclinical", "preclinical", "drug_dev", "en", 1.1),
    ("preclinical", "비임상", "drug_dev", "ko", 1.1),
    ("clinical", "clinical", "drug_dev", "en", 1.05),
    ("clinical", "임상", "drug_dev", "ko", 1.05),
    ("efficacy", "efficacy", "drug_dev", "en", 1.1),
    ("efficacy", "유효성", "drug_dev", "ko", 1.1),
    ("safety", "safety", "drug_dev", "en", 1.1),
    ("safety", "안전성", "drug_dev", "ko", 1.1),
    ("target", "target", "drug_dev", "en", 1.1),
    ("target", "타깃", "drug_dev", "ko", 1.1),
    ("target", "타겟", "drug_dev", "ko", 1.1),
    ("indication", "indication", "drug_dev", "en", 1.1),
    ("indication", "적응증", "drug_dev", "ko", 1.1),
    ("nsclc", "NSCLC", "drug_dev", "en", 1.2),
    ("nsclc", "비소세포폐암", "drug_dev", "ko", 1.2),
    ("cmc", "CMC", "drug_dev", "en", 1.05),
    ("cmc", "제조품질", "drug_dev", "ko", 1.05),
]
CANONICAL_BONUS = 0.05

STOPWORDS = [
    "the", "and", "for", "with", "from", "that", "this", "into", "were", "have",
    "대한", "관련", "대한한", "에서", "입니다", "있습니다", "하는", "및", "등", "자료",
    "문서", "내용", "요약", "설명", "정리", "해줘", "주세요",
]

OUTSIDE_SEARCH_ALPHABET = r"[^0-9a-z가-힣._+\-/]+"
TERM = r"[A-Za-z0-9][A-Za-z0-9._+\-/]{1,63}|[가-힣]{2,20}"
MAX_KEYWORDS = 48
HANGUL_TOKEN_WEIGHT, TOKEN_WEIGHT = 1.0, 0.9

# --- blocks and chunks ------------------------------------------------------

PAGE_MARK = "\n---\n"
CAPTION_LEADS = r"(?:figure|fig\.|table|표|그림)"
PAGE_READER_TYPES = ["pdf", "png", "jpg", "jpeg", "tif", "tiff"]
SUPPORTED_TYPES = ["pdf", "docx", "xlsx", "xls", "pptx", "png", "jpg", "jpeg", "tif", "tiff"]
CHUNK_SIZE, CHUNK_OVERLAP, MIN_SECTION_TOKENS = 512, 50, 80
SEPARATORS = ["\n\n", "\n", ". ", "? ", "! ", "; ", ", ", " "]

# --- retrieval --------------------------------------------------------------

BRANCH_LIMIT, RERANK_LIMIT, FUSION_K = 20, 5, 60
BM25_K1, BM25_B = 1.2, 0.75
VECTOR_DIM, DIGEST_PAIRS = 1024, 8

# hint words -> preference raised for (block type, value)
TABLE_HINTS = ["table", "표", "sheet", "excel", "엑셀", "row", "column", "행", "열", "셀"]
IMAGE_HINTS = ["image", "figure", "fig", "chart", "diagram", "사진", "이미지", "그림", "도표", "차트"]
CAPTION_HINTS = ["caption", "캡션", "figure legend", "table legend", "legend"]
SLIDE_HINTS = ["slide", "slides", "슬라이드", "deck", "ppt", "pptx"]
PAGE_HINTS = ["page", "pages", "페이지"]
BLOCK_PREFERENCES = {
    "table": [(TABLE_HINTS, 0.28)],
    "image": [(IMAGE_HINTS, 0.24)],
    "caption": [(TABLE_HINTS, 0.08), (IMAGE_HINTS, 0.16), (CAPTION_HINTS, 0.24), (SLIDE_HINTS, 0.1)],
    "text": [(SLIDE_HINTS, 0.06), (PAGE_HINTS, 0.04)],
}
SLIDE_QUERY_WORDS = ["slide", "슬라이드"]

# context message, as the answer generator expects it
CONTEXT_OPEN, CONTEXT_CLOSE = "=== 관련 문서 ===\n", "\n=== 문서 끝 ==="
CONTEXT_NOTE = "위 문서를 참고하여 답변하세요. 문서에 없는 내용은 모른다고 알려주세요."
WEB_OPEN, WEB_CLOSE = "=== 웹 검색 결과 ===\n", "\n=== 웹 검색 끝 ==="
WEB_NOTE = "위 웹 검색 결과도 참고하여 답변하세요."
DOCUMENT_WORD, WEB_WORD = "문서", "웹"
GRAPH_OPEN, GRAPH_CLOSE = "=== Graph Context ===\n", "\n=== End Graph ==="

# --- entities ---------------------------------------------------------------

ORG_SUFFIXES = [
    "유한책임회사", "주식회사", "유한회사", "합자회사", "합명회사",
    "사회적협동조합", "협동조합", "재단법인", "사단법인",
    "법인", "주식", "그룹", "홀딩스", "코퍼레이션",
    "본부", "사업부", "부서", "센터", "연구소", "연구원",
    "팀", "실", "부", "과", "처", "국", "원",
]
ORG_PREFIXES = ["주식회사", "유한회사", "재단법인", "사단법인", "협동조합"]
PERSON_TITLES = [
    "씨", "님", "대표", "이사", "부장", "차장", "과장", "팀장", "실장", "본부장", "사장", "회장",
    "대리", "사원", "주임", "교수", "박사", "선생", "원장", "소장", "연구원",
]
PERIODS = "1분기|2분기|3분기|4분기|상반기|하반기"
# (entity type, pattern), in the order the rules apply
ENTITY_PATTERNS = [
    ("ORG", r"[가-힣A-Za-z0-9&\s]{1,14}(?:" + "|".join(ORG_SUFFIXES) + ")"),
    ("ORG", "(?:" + "|".join(ORG_PREFIXES) + r")\s+[가-힣A-Za-z][가-힣A-Za-z0-9\s]{1,20}"),
    ("PERSON", r"[가-힣]{1}[가-힣]{1,3}(?:" + "|".join(PERSON_TITLES) + ")"),
    ("DATE", r"\d{4}년\s*\d{1,2}월(?:\s*\d{1,2}일)?"),
    ("DATE", r"\d{4}[-./]\d{1,2}[-./]\d{1,2}"),
    ("DATE", r"\d{1,2}월\s*\d{1,2}일"),
    ("DATE", r"\d{4}년도?"),
    ("DATE", "(?:" + PERIODS + r")\s*\d{4}년?"),
    ("DATE", r"\d{4}년?\s*(?:" + PERIODS + ")"),
    ("TECH", r"\b[A-Z]{2,}\b"),
    ("TECH", r"\b[A-Z][a-z]+(?:[A-Z][a-z]+)+\b"),
    ("TECH", r"\b[A-Za-z][A-Za-z0-9\-]{2,}\s*[vV]?\d+(?:\.\d+)*\b"),
]
ACRONYM_RULE = 9
MIN_ORG_SUFFIX_NAME = 3
ACRONYM_STOP_FORMS = [
    "THE", "AND", "FOR", "NOT", "BUT", "ARE", "WAS", "HAS",
    "PDF", "URL", "FAQ", "TBD", "ETC", "VS", "RE",
]

# --- sync, logs, sign-in ----------------------------------------------------

DOCUMENT_STATUSES = ["pending", "processing", "indexed", "failed"]
STAGES = ["mineru_parse", "chunk", "embed", "graph_extract", "index"]
STAGE_STATUSES = ["running", "success", "failed"]
SYNC_TYPES = ["user", "file", "full", "incremental"]
REMOVED_MESSAGE = "File removed from source"
SLOW_REQUEST_MS = 2000
UNLOGGED_PATHS = ["/health", "/docs", "/openapi.json", "/favicon.ico"]
LOCKOUT_FAILURES, LOCKOUT_MINUTES = 5, 30
