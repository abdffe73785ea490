"""Lists, patterns, limits and tables that results depend on."""

from __future__ import annotations

KINDS = ("heading", "paragraph", "list", "table", "code", "image", "callout", "macro", "slide")
DOC_TYPES = ("meeting-notes", "requirement", "design", "guide", "api-doc", "troubleshooting", "reference", "unknown")
SEVERITIES = ("error", "warning", "info")
AXES = ("structure", "context", "metadata")
SOURCE_KINDS = ("confluence", "pptx", "docx", "xlsx", "pdf")
LINK_TARGETS = ("internal", "external", "attachment", "anchor")
LINK_STATUSES = ("ok", "broken", "unchecked")

DOC_TYPE_LABELS = {
    "meeting-notes": "회의록", "requirement": "요구사항", "design": "설계", "guide": "가이드", "api-doc": "API 문서",
    "troubleshooting": "트러블슈팅", "reference": "레퍼런스", "unknown": "미분류",
}
SEVERITY_LABELS = {"error": "오류", "warning": "경고", "info": "참고"}
AXIS_LABELS = {"structure": "구조", "context": "맥락", "metadata": "메타데이터"}

#: rule id: (name, axis, severity, options, only these document types or None, judged by a model, judged by a query)
RULES = {
    "STR001": ("heading-hierarchy-skip", "structure", "warning", {}, None, False, True),
    "STR002": ("no-headings", "structure", "error", {"minChars": 800}, None, False, True),
    "STR003": ("section-too-long", "structure", "warning", {"maxSectionChars": 1500}, None, False, True),
    "STR004": ("table-as-image", "structure", "error", {}, None, False, True),
    "STR005": ("image-missing-alt", "structure", "error", {}, None, False, True),
    "STR006": ("code-block-no-language", "structure", "info", {"minLines": 3}, None, False, True),
    "STR007": ("vague-link-text", "structure", "warning", {}, None, False, True),
    "STR008": ("layout-table", "structure", "info", {}, None, False, True),
    "STR009": ("table-no-header", "structure", "warning", {}, None, False, True),
    "STR010": ("deep-nesting", "structure", "info", {"maxDepth": 3}, None, False, True),
    "STR011": ("attachment-only", "structure", "error", {"minChars": 200}, None, False, True),
    "STR012": ("unrendered-macro", "structure", "warning", {}, None, False, True),
    "STR013": ("emphasis-as-heading", "structure", "warning", {}, None, False, True),
    "STR014": ("scanned-pdf", "structure", "error", {}, None, False, True),
    "CTX001": ("dangling-reference", "context", "error", {}, None, True, False),
    "CTX002": ("undefined-term", "context", "warning", {}, None, True, False),
    "CTX003": ("missing-purpose", "context", "warning", {}, None, True, False),
    "CTX004": ("ambiguous-actor", "context", "warning", {}, None, True, False),
    "CTX005": ("unresolved-pronoun", "context", "warning", {}, None, True, False),
    "CTX006": ("relative-time", "context", "info", {}, None, True, False),
    "CTX007": ("decision-without-rationale", "context", "warning", {}, ("design", "meeting-notes", "requirement"), True, False),
    "CTX008": ("section-topic-drift", "context", "warning", {}, None, True, False),
    "CTX009": ("external-assumption", "context", "info", {}, None, True, False),
    "META001": ("title-not-descriptive", "metadata", "warning", {}, None, True, True),
    "META002": ("missing-summary", "metadata", "warning", {"minChars": 1200}, None, False, True),
    "META003": ("no-labels", "metadata", "info", {}, None, False, True),
    "META004": ("no-owner", "metadata", "info", {}, None, False, True),
    "META005": ("stale-document", "metadata", "info", {"staleMonths": 12}, None, False, True),
    "META006": ("broken-link", "metadata", "warning", {}, None, False, True),
    "META007": ("missing-required-section", "metadata", "error", {}, None, True, True),
    "META008": ("draft-marker", "metadata", "warning", {}, None, False, True),
}
#: Rule id: why what it finds harms a reader or a machine that reads.
WHY = {
    "STR001": "Sections are nested by their headings' levels; where a level is skipped, what belongs to what is lost.",
    "STR002": "Without headings a long text can't be cut into parts that stand for themselves.",
    "STR003": "A section that long holds several subjects, and is cut at places that mean nothing.",
    "STR004": "What is there only as an image can't be searched or quoted.",
    "STR005": "Without a describing text an image says nothing to who can't see it.",
    "STR006": "Without its language code is neither highlighted nor understood for what it is.",
    "STR007": "Out of its sentence such a link doesn't say where it leads.",
    "STR008": "A table for layout is read as data, and its reading order is lost.",
    "STR009": "Without a header row the columns' meaning must be guessed.",
    "STR010": "Depths of that kind are lost when a list becomes plain text.",
    "STR011": "Attachments aren't read with the page, so that the page is as good as empty.",
    "STR012": "What the macro shows is not in the text, only its name is.",
    "STR013": "Emphasised lines aren't headings to a machine, so the section isn't seen.",
    "STR014": "A scan without a text layer has no text to read.",
    "META001": "The title decides whether a document is found.",
    "META002": "Without a summary one must read it all to know what it is about.",
    "META003": "Labels narrow a search to the right kind of documents.",
    "META004": "Without an owner nobody is asked when something is wrong or old.",
    "META005": "A document not touched for so long may no longer hold.",
    "META006": "Who follows the link finds nothing.",
    "META007": "Readers of this kind of document look for these sections.",
    "META008": "Unfinished text is taken for what holds.",
}
PENALTY = {"error": 15, "warning": 6, "info": 2}
FULL_HITS = 3
WEIGHTS = {"structure": 0.35, "context": 0.45, "metadata": 0.20}
WEIGHT_TOLERANCE = 0.001
GRADES = ((90, "A"), (75, "B"), (60, "C"))

#: An ASCII word boundary on both sides, as ``\b`` isn't in Java beside letters of other scripts.
def bounded(word: str) -> str:
    return f"(?<![A-Za-z0-9_]){word}(?![A-Za-z0-9_])"


TABLE_HINT = "(?i)표|차트|그래프|다이어그램|아키텍처|플로우|table|chart|diagram"
#: One of these, in any case, stands in whatever TABLE_HINT, OWNER_TEXT or DRAFT_MARK finds: most texts are told without a search by pattern.
TABLE_HINT_NEEDS = ("표", "차트", "그래프", "다이어그램", "아키텍처", "플로우", "TABLE", "CHART", "DIAGRAM")
OWNER_TEXT_NEEDS = (":", "：")
DRAFT_MARK_NEEDS = ("TBD", "TODO", "FIXME", "XXX", "작성", "추후", "미정", "???")
IMAGE_FILE = r"(?i)\.(png|jpe?g|gif|svg|webp|bmp)$"
ALT_PLACEHOLDER = r"(?i)^(image|img|screenshot|picture|캡처|캡쳐|그림|이미지|스크린샷)[\s_-]*\d*$"
VAGUE_LINKS = (
    "여기", "이곳", "링크", "클릭", "여기를 클릭", "자세히", "자세히 보기", "더보기", "바로가기", "참고", "참조",
    "here", "click here", "link", "this", "this link", "read more", "more", "see", "see here",
)
CONTENT_MACROS = (
    "include", "excerpt-include", "excerpt", "multimedia", "viewxls", "viewpdf", "viewdoc", "viewppt", "widget", "iframe",
    "html", "drawio", "gliffy",
)
GENERIC_TITLES = (
    "회의록", "회의", "메모", "임시", "테스트", "문서", "노트", "자료", "정리", "초안", "untitled", "notes", "note", "memo",
    "test", "draft", "new page", "제목없음", "제목 없음",
)
DERIVED_TITLE = f"(?i)복사본|사본|백업|copy of|{bounded('copy')}|{bounded('old')}|deprecated"
SHORT_TITLE = 5
SUMMARY_HEADING = "(?i)요약|개요|한줄|한 줄|정리|배경|목적|tl;?dr|summary|overview|abstract|purpose"
LEAD_CHARS = 100
OWNER_TEXT = r"(?i)(작성자|담당자|책임자|owner|maintainer|responsible|poc)\s*[:：]\s*\S"
MONTH_MS = 30 * 24 * 60 * 60 * 1000
DRAFT_MARK = rf"(?i){bounded('TBD')}|{bounded('TODO')}|{bounded('FIXME')}|{bounded('XXX')}|작성\s?중|추후\s?작성|미정|\?{{3,}}"
EVIDENCE_CHARS = 60

#: Document type: its required sections, each a label with the words that also name it.
REQUIRED_SECTIONS = {
    "meeting-notes": (
        ("일시", "날짜", "개최일", "date", "when"),
        ("참석자", "참가자", "참석", "attendees", "participants"),
        ("결정사항", "결정 사항", "결론", "decisions", "decision"),
        ("액션아이템", "액션 아이템", "할 일", "todo", "action items", "actionitems", "후속 조치", "후속조치"),
    ),
    "requirement": (
        ("목적", "범위", "개요", "purpose", "scope", "overview"),
        ("요구사항", "요건", "requirements"),
        ("수용 기준", "수용기준", "완료 조건", "완료조건", "acceptance criteria", "acceptancecriteria", "dod"),
    ),
    "design": (
        ("배경", "문제", "문제 정의", "문제정의", "background", "problem", "context"),
        ("결정", "설계", "해결 방안", "해결방안", "decision", "design", "solution"),
        ("대안", "트레이드오프", "검토한 대안", "alternatives", "tradeoffs", "trade-offs"),
    ),
    "guide": (
        ("대상", "대상 독자", "대상독자", "audience", "who"),
        ("전제조건", "전제 조건", "사전 준비", "사전준비", "prerequisites", "requirements"),
        ("단계", "절차", "방법", "steps", "procedure", "how to", "howto"),
    ),
    "api-doc": (
        ("엔드포인트", "경로", "endpoint", "endpoints", "path", "url"),
        ("파라미터", "요청", "인자", "parameters", "params", "request"),
        ("응답", "반환", "response", "responses", "returns"),
        ("예시", "예제", "example", "examples", "sample"),
    ),
    "troubleshooting": (
        ("증상", "현상", "symptom", "symptoms", "issue"),
        ("원인", "분석", "cause", "root cause", "rootcause", "analysis"),
        ("해결", "조치", "해결 방법", "해결방법", "resolution", "solution", "fix"),
    ),
    "reference": (("정의", "설명", "용어", "definition", "definitions", "terms"),),
    "unknown": (),
}

LABEL_DOC_TYPES = {
    "meeting-notes": "meeting-notes", "meetingnotes": "meeting-notes", "minutes": "meeting-notes", "retrospective": "meeting-notes",
    "회의록": "meeting-notes", "회의": "meeting-notes", "requirement": "requirement", "requirements": "requirement", "prd": "requirement",
    "요구사항": "requirement", "design": "design", "adr": "design", "architecture": "design", "설계": "design", "guide": "guide",
    "howto": "guide", "manual": "guide", "runbook": "guide", "가이드": "guide", "api": "api-doc", "api-doc": "api-doc", "apidoc": "api-doc",
    "troubleshooting": "troubleshooting", "postmortem": "troubleshooting", "incident": "troubleshooting", "장애": "troubleshooting",
    "reference": "reference", "glossary": "reference", "policy": "reference", "용어집": "reference",
}
BLUEPRINTS = (
    ("meeting-notes", "meeting-notes"), ("retrospective", "meeting-notes"), ("requirements", "requirement"), ("decision", "design"),
    ("how-to-article", "guide"), ("troubleshooting-article", "troubleshooting"),
)

#: Identifier patterns in order of priority, and the kinds they name.
ID_PATTERNS = ((r"REQ-\d+", "requirement"), (r"TC-\d+", "test"), (r"[A-Z]{2,10}-\d+", "ticket"))
SNIPPET_CHARS = 400
MAX_PAIRS = 20
#: Pairs of documents of up to so many identifiers are counted by the subsets of them, 2 to that power at most, without listing
#: pairs; documents of more are compared with the others one by one (see trace.top_pairs and pairs_considered).
SUBSET_IDS = 10
#: Rule id: severity and what it says.
TRACE_RULES = {
    "TRC001": ("error", "an identifier is referred to that no document defines"),
    "TRC002": ("warning", "a design document mentions no requirement"),
    "TRC003": ("warning", "a requirement has no test"),
    "TRC004": ("error", "two documents define one identifier"),
    "TRC005": ("info", "a link leads to a document outside the index"),
    "TRC006": ("error", "two documents say different things of one identifier"),
}

MAX_BLOCKS = 2000
MAX_MODEL_CHARS = 200_000
CHUNK_CHARS = 12_000
SUMMARY_CHARS = 20_000
HEAD_CHARS = 500
INDEX_DOCS = 5000
CALLS_A_DAY = 200
LINKS_CHECKED = 40
MIN_CONFIDENCE = 0.6
FUZZY = 0.9
FUZZY_CHARS = 2000
QUOTE_CHARS, CONTEXT_CHARS, NEEDLE_CHARS = 120, 30, 40
