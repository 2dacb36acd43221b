"""Word lists, thresholds and patterns that results depend on, stated as they are."""

# Domain keywords, counted as substrings (order of domains decides ties).
CORPUS_DOMAINS = {
    "ai": ("artificial intelligence", "machine learning", "deep learning", "neural network", "transformer", "attention", "embedding", "pretraining", "llm", "model training"),
    "databases": ("database", "sql", "query", "index", "transaction", "postgres", "mysql", "mongodb", "replication", "sharding", "schema", "table"),
    "software_engineering": ("software", "engineering", "deployment", "testing", "refactor", "api", "git", "docker", "kubernetes", "ci/cd", "code review", "repository"),
}

# Domain keywords of imported pairs, each counted once where it stands as a word.
PAIR_DOMAINS = {
    "software_engineering": ("api", "class", "code", "debug", "function", "git", "javascript", "python", "refactor", "software", "test", "typescript"),
    "databases": ("database", "index", "join", "query", "sql", "table", "transaction"),
    "ai": ("ai", "attention", "embedding", "language model", "machine learning", "model", "neural", "token", "transformer"),
    "cybersecurity": ("authentication", "cryptography", "cybersecurity", "encryption", "exploit", "malware", "password", "phishing", "security", "vulnerability"),
}
PAIR_DOMAIN_SET = ("software_engineering", "databases", "ai", "cybersecurity", "general")

# Words that mark English, and the weights of the language score.
ENGLISH_MARKERS = ("the", "and", "is", "to", "of", "in", "for", "with", "that", "this", "are", "on", "as", "by", "from")
MARKER_WEIGHT, ASCII_WEIGHT, ENGLISH_FROM = 0.55, 0.45, 0.35

# The quality gate's thresholds.
MIN_WORDS, MIN_UNIQUE, MAX_LINE_REPETITION, MIN_LANGUAGE = 20, 0.25, 0.35, 0.30

# Lines that cleaning drops.
NAVIGATION_LINE = r"(?i)^(?:home|contact|login|sign in|privacy|terms|menu|navigation)\s*(?:\||/|-)\s*"
SEPARATOR_LINE = r"^[\s\-_|=*#]{3,}$"
FOOTER_LINE = r"(?i)^(?:copyright|all rights reserved|page \d+ of \d+|last updated).*$"
PIPE_LINE = r"(?i)^(?:\|\s*)+(?:home|contact|login)(?:\s*\|)*$"
LOREM = r"(?i)\blorem ipsum\b"
CHARACTER_SPAM = r"(?s)(.)\1{7,}"

# Tokens estimated for a word.
TOKENS_PER_WORD = 1.35

# Chat markers, and marks of scaffolded prompts.
USER, ASSISTANT, END = "<USER>", "<ASSISTANT>", "<END>"
SCAFFOLDING = ("Input:", "Output:", "Instruction:", "Response:")

# Weights of the composite answer score and the limits of its parts.
SCORE_RECALL, SCORE_OVERLAP, SCORE_SANE, SCORE_GROUNDED = 0.35, 0.35, 0.15, 0.15
EMPTY_BELOW, UNGROUNDED_BELOW, UNGROUNDED_FROM_WORDS = 4, 0.12, 8

# Section markers that corpus cleaning removes.
SECTION_MARKERS = (
    r"^=== DOMAIN: .+ ===\s*$", r"^=== Topic: .+ ===\s*$", r"^=== Book \d+ ===\s*$", r"^Scene \d+\s*$",
    r"^=== Supplement \d+ ===\s*$", r"^=== Technical \d+ ===\s*$", r"^={3,}[^=\n]*={3,}\s*$",
)

# Words that decoding parts from a hyphenated word in front of them.
GLUED_WORDS = ("and", "or", "for", "the", "with", "to", "in", "on", "at", "by", "is", "are", "was", "from", "that", "this", "as", "an", "be", "of")

# Words that never are expected keywords of an answer.
KEYWORD_STOPWORDS = (
    "the", "a", "an", "and", "or", "to", "of", "in", "for", "on", "with", "is", "are", "was", "were", "be", "by", "as", "at", "it", "that", "this",
    "from", "can", "may", "such", "using", "used", "when", "which", "their", "they", "them", "into", "through", "also", "than", "other", "more",
    "most", "one", "two", "how", "what", "why",
)

# Domains of each benchmark bucket.
BUCKETS = {
    "ai": ("ai_basics", "machine_learning", "deep_learning", "nlp", "statistics", "math_basics", "math_for_ml", "logic_reasoning", "transformers_llms"),
    "databases": ("databases", "sql", "data_structures"),
    "programming": ("python", "javascript", "html_css", "web_development", "software_engineering", "algorithms"),
    "system_design": ("system_design", "devops", "linux", "networking", "operating_systems", "cybersecurity", "cloud_computing"),
    "general_knowledge": ("daily_life", "general_science", "geography_basics", "history_basics", "study_skills", "writing_communication", "business_basics", "computer_vision"),
}

# Limits of curated examples (words), the buckets they fill in turn, and openings that are too generic.
CURATED_INSTRUCTION, CURATED_RESPONSE = (4, 25), (20, 90)
CURATED_BUCKETS = ("ai", "databases", "software_engineering", "cybersecurity_general")
GENERIC_OPENINGS = (
    "describe a time", "give three tips", "write a story", "write a poem", "generate a poem", "create a slogan", "make a list", "name three",
    "translate", "edit the following", "classify the following",
)

# Words that make a general pair technical.
TECHNICAL_KEYWORDS = (
    "ai", "artificial", "intelligence", "machine", "learning", "model", "token", "transformer", "algorithm", "data", "database", "index", "sql", "query",
    "python", "function", "code", "api", "software", "engineering", "debug", "test", "security", "cybersecurity", "network", "encryption", "docker",
)

# Nouns in front of a bare article that tell of a missing verb, at an answer's start.
BARE_NOUNS = ("attention", "self-attention", "tokenizer", "tokenization", "ai", "index", "database")

# Acronyms that are no gibberish; a word of 5 to 20 letters outside the known ones is, if it falls into so many tokens.
ACRONYMS = ("ai", "api", "bpe", "cpu", "gpu", "gpt", "json", "llm", "sql", "ui")
FRAGMENT_LETTERS, FRAGMENT_TOKENS, FRAGMENT_SHARE = (5, 20), 3, 0.3

# Rates from which the risk of memorisation counts points, and the points of its tiers.
RISK_PARAGRAPH, RISK_LINE, RISK_NEAREST, RISK_REPETITION = ((0.34, 2), (0.0, 1)), 0.34, ((0.90, 2), (0.80, 1)), 0.20
RISK_HIGH, RISK_MODERATE = 4, 2

# Weights of the checkpoint score.
CHECKPOINT_WEIGHTS = {"topic": 100.0, "chat": 12.0, "repetitions": -18.0, "gibberish": -2.0, "drifts": -10.0}

# Markers and punctuation that a vocabulary must hold.
SPECIAL_MARKERS = ("<USER>", "<ASSISTANT>", "<END>")

# Routing accuracy and drop of confusion from which a comparison names its cause.
ROUTING_FROM, CONFUSION_DROP = 0.8, 0.1

# What makes a question a comparison, and limits of short and of shortened answers.
COMPARISON = (
    r"(?i)\b(compare|contrast|different|distinguish|versus|\bvs\b|without mixing|not be confused|instead of|operating difference|would not be an example|"
    r"do not confuse|should not be confused|how is .+ different|what distinguishes|mixing their roles)\b"
)
SHORT_WORDS = (12, 35)
SHORTEN_SENTENCES, SHORTEN_WORDS, SHORTEN_LEAST = 3, 55, 8

# What a contrast concept's routing score counts of itself; how raw corpus text begins; the style prefix of prompts.
CONTRAST_DISCOUNT = 0.20
RAW_STARTS = ("teams should write", "example note", "database systems need", "this text is about", "topic:")
PARAGRAPH_PREFIX = "Write one coherent paragraph about "
