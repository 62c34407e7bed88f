"""Fixed values that results depend on: word lists, phrases, weights and limits."""

# --- cleaning ---------------------------------------------------------------
NOISE_REPLACEMENTS = [
    ("Click to copy article linkArticle link copied!", ""),
    ("Click to copy section linkSection link copied!", ""),
    ("High Resolution ImageDownload MS PowerPoint Slide", ""),
    ("Download Hi-Res ImageDownload to MS-PowerPoint", ""),
    ("CloseNextPrevious", ""),
    ("Request reuse permissions", ""),
    ("<redacted_base64>", ""),
    ("[url]", " "),
]
NOISE_LINES = [
    "advertisement", "download pdf", "download citation", "jump to", "metrics", "altmetric",
    "crossmark", "share", "share icon", "skip to figshare navigation", "skip to main content", "view metrics",
]
COUNT_PREFIX_LINES = ["download pdf", "metrics"]

#: Which sources a layer is for: parts of the lower-cased source, and whole tokens of it.
SOURCE_TESTS = {
    "acs": (["acs", "american chemical society"], []),
    "elsevier": (["elsevier", "sciencedirect"], []),
    "rsc": (["royal society of chemistry", "rsc publishing"], ["rsc"]),
    "wiley": (["wiley"], []),
    "springer": (["springer"], []),
    "nature": (["nature"], []),
}
#: Prefixes of noise lines that two publishers share.
SPRINGER_PREFIXES = [
    "description of additional supplementary files", "publisher's note springer nature remains neutral", "publisher’s note springer nature remains neutral",
    "springer nature remains neutral with regard", "supplementary file", "supplementary movie", "supplementary video",
]
#: Further layers of a publisher; more can be passed as a parameter in the same form.
SOURCE_LAYERS = {
    "acs": {
        "replacements": [
            ("View Author Information", " "), ("Click to copy citationCitation copied!", " "), ("Open PDF", " "),
            ("PDFSupporting Information", " Supporting Information "), ("ShareShare", "Share"), ("toExpandCollapse", " "),
            ("Cite This:", " "), ("Cite this:", " "), ("Publication History", " "), ("research-article", " "), ("More by", " "),
        ],
        "lines": ["get e-alerts", "add to favorites", "supporting information", "article views"],
        "counts": ["article views", "citations"],
        "prefixes": ["this article is cited by", "copyright ©", "this publication is licensed under"],
    },
    "elsevier": {
        "replacements": [
            ("Author links open overlay panel", " "), ("Show more", " "), ("Add to Mendeley", " "),
            ("ShareCite[url] rights and content", " "), ("Cite[url] rights and content", " "), ("Full text access", " "),
            ("Previous article in issue", " "), ("Next article in issue", " "), ("Recommended articles", " "), ("View Abstract", " "),
        ],
        "lines": ["recommended articles", "cited by", "view pdf", "article preview", "author links open overlay panel", "show more", "show less"],
        "counts": ["recommended articles", "cited by"],
        "prefixes": [],
    },
    "rsc": {
        "replacements": [("Show Compounds", " "), ("Show Chemical Terms", " ")],
        "lines": ["article information", "back to tab navigation", "permissions", "show chemical terms", "show compounds", "social activity", "supplementary information"],
        "counts": [],
        "prefixes": ["this journal is © the royal society of chemistry"],
    },
    "wiley": {
        "replacements": [],
        "lines": ["citing literature", "email alerts", "figures", "get access", "sections", "share", "supporting information", "tools"],
        "counts": ["citing literature", "figures", "sections"],
        "prefixes": ["article metrics"],
    },
    "springer": {
        "replacements": [],
        "lines": [
            "about this article", "access this article", "article metrics", "about nature portfolio", "nature awards", "nature careers", "nature index",
            "nature masterclasses", "nature portfolio policies", "provided by the springer nature sharedit content-sharing initiative", "publisher's note",
            "reprints and permissions", "rights and permissions", "share this article", "supplementary information",
        ],
        "counts": ["about this article", "article metrics"],
        "prefixes": SPRINGER_PREFIXES,
    },
    "nature": {
        "replacements": [],
        "lines": [
            "about this article", "access through your institution", "provided by the springer nature sharedit content-sharing initiative",
            "rights and permissions", "share this article", "subjects", "supplementary information",
        ],
        "counts": ["about this article", "subjects"],
        "prefixes": SPRINGER_PREFIXES,
    },
}
REFERENCE_TITLES = ["references", "reference", "bibliography", "literature cited", "cited literature", "参考文献"]

# --- classification ---------------------------------------------------------
SECTION_KINDS = [
    ("abstract", 0.95, ["abstract"]),
    ("methods", 0.95, ["method", "experiment", "synthesis", "preparation"]),
    ("results", 0.9, ["result", "finding", "performance", "benchmark"]),
    ("discussion", 0.8, ["discussion", "analysis"]),
    ("conclusion", 0.8, ["conclusion", "summary"]),
    ("limitation", 0.85, ["limitation", "future work"]),
    ("dataset", 0.85, ["dataset", "data set", "database", "data"]),
    ("introduction", 0.65, ["introduction", "overview"]),
    ("background", 0.55, ["background", "literature review"]),
]
REFERENCE_NEEDLES = ["reference", "references", "bibliography", "literature cited", "works cited"]
PUBLISHER_PHRASES = [
    "download pdf", "view article", "rights and permissions", "article metrics", "related articles",
    "sign in", "subscribe", "cookie", "privacy policy",
]
MECHANISM_NEEDLES = ["mechanism", "pathway", "active site", "vacancy"]
METRIC_NEEDLES = ["%", "mae", "rmse", "conversion", "selectivity", "yield", "accuracy", "capacity", "conductivity", "turnover frequency", "tof", "ph "]
FACT_TYPES = {
    "methods": "method", "results": "result", "limitation": "limitation", "dataset": "dataset", "metric": "metric",
    "mechanism": "mechanism", "figure_caption": "figure_caption", "table_caption": "table_caption", "abstract": "context",
    "introduction": "context", "background": "context", "discussion": "context", "conclusion": "context", "unknown": "context",
}
FACT_RANKS = {
    "result": 90, "method": 80, "mechanism": 75, "dataset": 70, "metric": 65, "limitation": 60, "context": 40,
    "figure_caption": 30, "table_caption": 30,
}
KEYWORD_STOP = ["this", "that", "with", "from", "under", "paper", "study", "using"]
SECTION_FACTS = [("method", ["method", "experiment"]), ("result", ["result", "discussion", "conclusion"]), ("limitation", ["limitation"]), ("dataset", ["dataset", "data"]), ("metric", ["metric"])]

# --- questions --------------------------------------------------------------
FACT_INTENTS = [
    ("method", ["方法", "怎么做", "method", "synthesis", "characterization"]),
    ("result", ["结果", "性能", "提升", "conversion", "capacity", "result"]),
    ("limitation", ["局限", "不足", "limitation", "limits"]),
    ("dataset", ["数据集", "数据", "dataset", "data"]),
    ("metric", ["指标", "metric", "accuracy", "efficiency"]),
    ("figure_caption", ["图", "figure", "fig", "fig.", "caption"]),
    ("table_caption", ["表", "table", "caption"]),
    ("experiment_condition", ["实验条件", "temperature", "pressure", "condition"]),
]
DETAIL_KEYWORDS = [
    "原文", "引用", "证据", "具体", "数值", "多少", "性能", "实验", "条件", "机制", "比较", "对比", "figure", "table", "doi",
    "数据", "which paper", "which 2026", "which review", "which perspective", "which strategy", "what lattice", "what charge",
    "what latent", "how does the", "claim", "connect", "reports", "reported", "uses ", "proposes",
]
EVIDENCE_KEYWORDS = [
    "依据", "证据", "来源", "出处", "原文", "引用", "在哪", "在哪里", "哪一段", "哪篇", "chunk", "source", "evidence", "citation",
    "cite", "quote", "reference",
]
RANK_STOP = [
    "the", "and", "for", "with", "from", "into", "what", "which", "paper", "papers", "review", "perspective", "reports", "reported",
    "uses", "use", "cover", "covers", "connect", "connects", "about", "does", "how", "2026",
]
SYNONYMS = {"mof": ["metal organic framework", "metal organic frameworks"], "oer": ["oxygen evolution"]}
#: Further synonyms of the terms that chunks are ranked by.
SMART_GARMENTS = ["smart garments", "smart garment", "phase change fabrics", "phase change garment"]
CHUNK_SYNONYMS = SYNONYMS | {word: SMART_GARMENTS for word in ("wearable", "thermoregulation", "phase change", "phase change materials")}
PROFILE_WEIGHTS = {"doi": 10, "title": 5, "topic_keywords": 4, "key_results": 4, "methods": 3, "limitations": 3, "one_sentence_summary": 2}
INSUFFICIENT = ["insufficient_context", "证据不足", "信息不足"]
UNCERTAIN = ["uncertain", "limited evidence", "partial support", "不确定", "证据有限", "可能"]

INSTRUCTION_PHRASES = [
    "ignore previous", "ignore all previous", "system prompt", "developer message", "act as chatgpt", "act as an ai", "act as a helpful assistant",
    "忽略之前", "忽略以上", "系统提示", "开发者消息", "你现在是",
]

# --- ranking ----------------------------------------------------------------
ROUTE_LIMIT = 30
RRF_OFFSET = 60
LEXICAL_SEEDS = 3
BM25_K1, BM25_B, BM25_FLOOR = 1.2, 0.75, 1e-6
HASH_DIMENSION = 64

# --- papers -----------------------------------------------------------------
PARSER_VERSION, CLEANER_VERSION = "parser-v1", "source-cleaner-v13"
TITLE_BLOCKED = [
    "abstract", "electronic supplementary material", "keywords", "introduction", "copyright", "downloaded", "journal", "volume",
    "page ", "doi:", "http://", "https://", "university", "laboratory", "college", "department", "institute", "correspondence",
    "received:", "accepted:", "published",
]
CHUNK_CHARS, CHUNK_OVERLAP = 3200, 350
METRIC_PHRASES = [
    "conversion", "selectivity", "yield", "efficiency", "faradaic efficiency", "fe", "current density", "surface area",
    "bet surface area", "capacity", "retention", "overpotential", "voltage", "potential", "temperature", "pressure", "ph", "rate",
    "tof", "turnover frequency",
]
