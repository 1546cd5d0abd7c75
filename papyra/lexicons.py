"""Fixed values that must equal the reference behaviour for identical results.

Everything here is data, not logic: lexicons, regex patterns and constants.
They are kept together, in their natural order, so operators take them as
parameters and tests can swap them.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the reference to reproduce its results)
# ---------------------------------------------------------------------------

# Resume classifier, first version.
RESUME_V1_KEYWORDS = [
    "resume", "curriculum vitae", "cv", "professional summary", "objective",
    "skills", "experience", "education", "certifications", "projects",
    "languages", "references", "awards", "honors",
]
RESUME_V1_SECTIONS = [
    "work experience", "professional experience", "employment history",
    "education", "academic background", "skills", "certifications",
    "projects", "summary", "languages", "references", "awards", "honors",
]
RESUME_V1_TITLES = ["software", "engineer", "developer", "manager", "analyst", "consultant", "specialist"]
RESUME_V1_COMPANY_WORDS = ["inc", "llc", "corp", "ltd", "company", "co", "limited", "group"]

# Resume classifier, second version (no company-word test).
RESUME_V2_KEYWORDS = [
    "resume", "curriculum vitae", "cv", "professional summary", "objective",
    "skills", "experience", "education", "certifications", "projects",
]
RESUME_V2_SECTIONS = [
    "work experience", "professional experience", "employment history",
    "education", "academic background", "skills", "certifications",
]
RESUME_V2_TITLES = ["software", "engineer", "developer", "manager", "analyst", "consultant"]

# Contact-information patterns (Python `re` syntax, applied to cleaned text).
EMAIL_PATTERN = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
PHONE_PATTERN = r"\b(?:\+?(\d{1,3}))?[-.\s]?(\(?\d{3}\)?)[-.\s]?(\d{3})[-.\s]?(\d{4})\b"
LINKEDIN_PATTERN = r"https?://(?:www\.)?linkedin\.com/in/[\w-]+"
GITHUB_PATTERN = r"https?://(?:www\.)?github\.com/[\w-]+"
URL_PATTERN = r"https?://(?:www\.)?\S+\.\S+"
DATE_PATTERN = r"\b\d{4}[-/]\d{2}[-/]\d{2}\b|\b\d{4}\b"

# HTML-to-plain cleaner: five substitutions applied in this order, then trim.
HTML_CLEAN_STEPS = [
    (r"<[^>]+>", ""),
    (r"\s*([a-zA-Z-]+:\s*[^;]+;?)\s*", ""),
    (r"url\(\s*.*?\)", ""),
    (r"[^a-zA-Z0-9\s.,;:?!'\"()\-]", ""),
    (r"\s+", " "),
]

# Supported document extensions (lower-cased suffix match).
SUPPORTED_EXTENSIONS = [".pdf", ".doc", ".docx", ".html"]

# Chunking defaults and separators of the recursive splitter.
CHUNK_SIZE = 1000
CHUNK_OVERLAP = 200
CHUNK_SEPARATORS = ["\n\n", "\n", " ", ""]

# Match rubric weights: skills, experience, projects, education + certifications.
MATCH_WEIGHTS = {"skills": 0.4, "experience": 0.3, "projects": 0.2, "education": 0.1}

# Clustering settings.
TFIDF_NUM_FEATURES = 5000
KMEANS_K = 9
KMEANS_SEED = 1
KMEANS_MAX_ITER = 50
ELBOW_K_RANGE = (5, 10)

# Vector collection settings.
VECTOR_SHARDS = 4
SEARCH_LIMIT = 5

# Spark ML's default English stop-word list (StopWordsRemover, 181 words);
# written out so the DuckDB oracle can use the same list without a JVM.
ENGLISH_STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours",
    "yourself", "yourselves", "he", "him", "his", "himself", "she", "her", "hers", "herself",
    "it", "its", "itself", "they", "them", "their", "theirs", "themselves", "what", "which",
    "who", "whom", "this", "that", "these", "those", "am", "is", "are", "was", "were", "be",
    "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an",
    "the", "and", "but", "if", "or", "because", "as", "until", "while", "of", "at", "by",
    "for", "with", "about", "against", "between", "into", "through", "during", "before",
    "after", "above", "below", "to", "from", "up", "down", "in", "out", "on", "off", "over",
    "under", "again", "further", "then", "once", "here", "there", "when", "where", "why",
    "how", "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "no",
    "nor", "not", "only", "own", "same", "so", "than", "too", "very", "s", "t", "can", "will",
    "just", "don", "should", "now", "i'll", "you'll", "he'll", "she'll", "we'll", "they'll",
    "i'd", "you'd", "he'd", "she'd", "we'd", "they'd", "i'm", "you're", "he's", "she's",
    "it's", "we're", "they're", "i've", "we've", "you've", "they've", "isn't", "aren't",
    "wasn't", "weren't", "haven't", "hasn't", "hadn't", "don't", "doesn't", "didn't", "won't",
    "wouldn't", "shan't", "shouldn't", "mustn't", "can't", "couldn't", "cannot", "could",
    "here's", "how's", "let's", "ought", "that's", "there's", "what's", "when's", "where's",
    "who's", "why's", "would",
]
