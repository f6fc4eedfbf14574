"""Word lists, weights, patterns and labels that results depend on, in their natural order."""

# ---- fixed values: dates, money, names ----
MONTH = (
    r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|"
    r"sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
)
DATES = [
    rf"\b{MONTH}\s+\d{{1,2}}(?:,\s*\d{{4}})?\b",
    rf"\b\d{{1,2}}\s+{MONTH}\s+\d{{4}}\b",
    r"\b\d{4}-\d{2}-\d{2}\b",
    r"\b\d{1,2}/\d{1,2}/\d{2,4}\b",
]
CURRENCY = r"\b(?:HK\$|HKD|US\$|USD|EUR|GBP|\$)\s*\d[\d,]*(?:\.\d{2})?\b"
AMOUNT = r"\d[\d,]*(?:\.\d{2})?"
PROGRAM_NAMES = [
    r"\b(?:Master|Doctor|Bachelor)\s+of\s+[A-Za-z][A-Za-z0-9&(),/ \-]{4,}",
    r"\b(?:MSc|MS|MA|MPhil|PhD|MBA|LLM)\s*(?:\([^)]+\)|in\s+[A-Za-z][A-Za-z0-9&(),/ \-]+)?",
]
DEPARTMENTS = [
    r"\b(?:Department|School|Faculty|College|Institute)\s+of\s+[A-Za-z][A-Za-z0-9&(),/ \-]{2,}",
    r"\b(?:Department|School|Faculty|College|Institute)\s+[A-Za-z][A-Za-z0-9&(),/ \-]{2,}",
]
UNITS = r"\b\d(?:\.\d+)?\s*(?:year|years|month|months)\b"
DURATIONS = [
    UNITS + r"(?:[^.]{0,80}?\b(?:full[- ]time|part[- ]time)\b)?",
    r"\b(?:full[- ]time|part[- ]time)\b[^.]{0,80}?" + UNITS,
]

# ---- fixed values: replaced before anything else ----
REPLACED = {" ": " ", "‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-"}
REPLACED_MORE = {"聽": " ", "鈥n": " ", "鈥?": " ", "鉁昞n": " ", "芦": " ", "禄": " ", "漏": "©"}

# ---- fixed values: labels and keywords of lines ----
HEADER_LABELS = ["english requirement", "english requirements", "english language requirement", "english language requirements", "english proficiency requirement", "english proficiency requirements", "academic requirement", "academic requirements", "admission requirement", "admission requirements", "entry requirement", "entry requirements", "prerequisite", "prerequisites", "tuition fee", "tuition fees", "programme fee", "programme fees", "program fee", "program fees", "admission schedule", "application schedule", "important dates", "key dates"]
HEADER_WORDS = ["requirement", "requirements", "deadline", "deadlines", "tuition", "fee", "fees", "schedule", "dates", "duration", "instruction", "documents", "prerequisite", "prerequisites", "information"]
ENGLISH_LABELS = ["english requirement", "english requirements", "english language requirement", "english language requirements", "english proficiency requirement", "english proficiency requirements", "proof of english proficiency"]
ACADEMIC_LABELS = ["academic requirement", "academic requirements", "admission requirement", "admission requirements", "entry requirement", "entry requirements"]
DEADLINE_LABELS = ["application deadline", "application deadlines", "deadline for application", "deadline for applications", "priority deadline", "submission deadline", "submit your application by", "deadline", "deadlines", "apply by", "applications close", "application closes", "closing date", "closing dates", "admission schedule", "application schedule", "important dates", "key dates", "timeline"]
TUITION_LABELS = ["tuition fee", "tuition fees", "tuition", "programme fee", "programme fees", "program fee", "program fees", "fee", "fees"]
DURATION_LABELS = ["duration", "study period", "normal study period", "period of study", "study mode"]
OPENING = ["opens on", "opening on", "opening date", "open on", "intake opens", "applications open", "application opens"]
TUITION_REJECTED = ["application fee", "application fees", "application form fee", "caution money", "student activity fee", "graduation fee", "re-examination", "re examination", "repeating", "tuition fee reduction", "fee reduction", "credit transfer", "exemption", "micromasters"]
TUITION_CONTEXT = ["fee", "fees", "tuition", "programme", "program", "local", "non-local", "non local", "students"]
TUITION_SCORED = ["tuition", "fee", "fees", "instalment", "installment", "payable", "programme", "program", "local", "non-local", "non local", "students"]
DURATION_NOISE = ["tuition fee", "tuition fees", "programme fee", "program fee", "scholarship", "fellowship", "ftss"]
DEADLINE_REJECTED = ["please visit", "for details", "for detail", "read article", "application method", "for more information", "for the latest information"]
DEADLINE_EVENTS = ["fair", "information session", "webinar", "event", "pm", "am"]
DEADLINE_CONTEXT = ["schedule", "deadline", "deadlines", "closing date", "important dates", "key dates", "timeline", "round"]
ENGLISH_TESTS = ["ielts", "toefl", "pte", "duolingo"]
ENGLISH_SIGNALS = ["english language requirement", "english language requirements", "university english language requirement", "language requirement", "language requirements", "language proficiency", "english proficiency", "proof of english proficiency", "expected to satisfy", "must satisfy", "required to satisfy", "shall satisfy", "satisfy the university english language requirement", "waiver", "waive", "exemption", "exempt"]
INSTRUCTION = ["medium of instruction", "language of teaching", "language of instruction", "taught in english", "teaching and/or examination"]
QUESTIONS = ["are there any", "do i need to", "what are the minimum", "how may we help you", "search for"]
ACADEMIC_CONTENT = ["bachelor", "degree", "gpa", "honours", "honors", "upper second", "recognized university", "equivalent qualification", "course in", "courses in", "certificate course", "subjects", "related areas", "calculus", "algebra", "programming", "statistics"]
ACADEMIC_CONTEXT = ["applicant", "admission", "eligible", "require", "must hold", "should hold", "should have"]
ACADEMIC_COURSES = ["have taken at least one", "course in", "courses in", "certificate course", "subjects", "related areas", "calculus", "algebra", "programming", "statistics"]
ACADEMIC_PEOPLE = ["applicants", "applicant", "candidates", "must hold", "shall hold", "should hold", "should have"]
PREREQUISITE_CONTEXT = ["prerequisite", "prerequisites", "background in", "knowledge of", "experience in", "experience with", "familiar with", "prior knowledge", "prior background", "applicants should have", "have taken at least one", "course in", "certificate course", "related areas", "subjects"]
PREREQUISITES = [
    ("computer science", r"\bcomputer science\b"), ("mathematics", r"\bmathematics?\b|\bmath\b"), ("statistics", r"\bstatistics?\b"),
    ("algebra", r"(?<!linear )\balgebra\b"), ("probability", r"\bprobabilit(?:y|ies)\b"), ("linear algebra", r"\blinear algebra\b"),
    ("calculus", r"\bcalculus\b"), ("programming", r"\bprogramming\b"), ("python", r"\bpython\b"), ("machine learning", r"\bmachine learning\b"),
    ("algorithms", r"\balgorithms?\b"), ("data structures", r"\bdata structures?\b"),
]
FOUNDATIONS = {
    "statistics": r"\bstatistics?\b|\bprobabilit(?:y|ies)\b",
    "programming": r"\bprogramming\b|\bpython\b|\bcoding\b",
    "mathematics": r"\bmathematics?\b|\bmath\b|\bcalculus\b|\balgebra\b|\blinear algebra\b",
}
MIXED_TAILS = [r"\bapplicants?\s+must\s+possess\b", r"\bapplicants?\s+shall\s+possess\b", r"\bapplicants?\s+should\s+possess\b", r"\bapplicants?\s+must\s+hold\b", r"\bcandidates?\s+must\s+possess\b"]

# ---- fixed values: link patterns and weights ----
LINK_POSITIVE = [(r"\badmissions?\b", 5), (r"\bapply\b", 4), (r"\bapplications?\b", 4), (r"\brequirements?\b", 4), (r"\bdeadline(?:s)?\b", 4), (r"\btuition\b", 4), (r"\bfees?\b", 4), (r"\bfaq\b|\bfrequently asked questions\b", 2), (r"\benglish\b", 2), (r"\bielts\b", 3), (r"\btoefl\b", 3)]
LINK_NEGATIVE = [(r"\bnews\b", 5), (r"\bcontact\b", 4), (r"\bcurrent students?\b", 5), (r"\bsocial\b", 4), (r"\bposter\b", 4), (r"\bvideos?\b", 4), (r"\byoutube\b", 5), (r"\bfacebook\b", 4), (r"\binstagram\b", 4), (r"\blinkedin\b", 4), (r"\btwitter\b", 4)]
TOPIC_ADMISSIONS = [r"\badmissions?\b", r"\bapply\b", r"\bapplications?\b"]
TOPIC_DECISION = [r"\brequirements?\b", r"\bdeadline(?:s)?\b", r"\benglish\b", r"\bielts\b", r"\btoefl\b"]
TOPIC_FEES = [r"\btuition\b", r"\bfees?\b", r"\bprogramme fees?\b", r"\bprogram fees?\b"]
TOPIC_ENGLISH = [r"\benglish\b", r"\bielts\b", r"\btoefl\b"]
TOPIC_FAQ = [r"\bfaq\b", r"\bfrequently asked questions\b"]
FOLLOW_UP = {
    "deadline": [(r"\bapplication deadline(?:s)?\b", 7), (r"\bdeadline(?:s)?\b", 6), (r"\bapply(?:\s+now)?\b", 5), (r"\bapplications?\b", 4), (r"\badmissions?\b", 4), (r"\badmission procedure\b", 5), (r"\bimportant dates\b", 4), (r"\bkey dates\b", 4), (r"\bschedule\b", 3)],
    "tuition": [(r"\btuition(?:\s+fees?)?\b", 6), (r"\btuition and fees\b", 7), (r"\b(?:programme|program)\s+fees?\b", 7), (r"\b(?:programme|program)\s+costs?\b", 5), (r"\bprogramme\b", 2), (r"\bprogram\b", 2), (r"\bfees?\b", 4), (r"\bcosts?\b", 3)],
    "english_requirement": [(r"\benglish(?:\s+language)?\b", 5), (r"\benglish language requirements?\b", 7), (r"\blanguage requirements?\b", 6), (r"\blanguage proficiency\b", 6), (r"\benglish proficiency\b", 6), (r"\bielts\b", 6), (r"\btoefl\b", 6), (r"\bmedium of instruction\b", 4), (r"\bexempt(?:ion|ed)?\b", 3), (r"\bwaiv(?:e|er|ers)\b", 3)],
}
FOLLOW_UP_SHARED = [(r"\bfaq\b|\bfrequently asked questions\b", 2)]
SECOND_LEVEL = ["co", "com", "org", "net", "gov", "edu", "ac"]

# ---- fixed values: which page a field is best taken from ----
HINTS = {
    "program_name": [("programme information", 6), ("program information", 6), ("overview", 5), ("programme", 3), ("program", 3), ("master", 2), ("msc", 2)],
    "department": [("department", 8), ("school", 6), ("faculty", 6), ("college", 5), ("about", 2), ("programme information", 2)],
    "duration": [("duration", 8), ("study mode", 5), ("full-time", 4), ("part-time", 4), ("programme information", 2), ("program information", 2), ("overview", 1)],
    "deadline": [("application deadline", 6), ("application deadlines", 6), ("admission procedure", 5), ("admissions", 5), ("admission", 4), ("deadline", 3), ("admission", 2), ("application", 2), ("apply", 2), ("schedule", 2), ("important dates", 2), ("key dates", 2), ("round", 1)],
    "tuition": [("programme information", 6), ("program information", 6), ("overview", 4), ("programme fee", 6), ("program fee", 6), ("programme", 3), ("program", 3), ("tuition", 3), ("fee", 3), ("fees", 3), ("cost", 2)],
    "english_requirement": [("english faq", 8), ("graduate school requirements", 8), ("admissions requirements", 6), ("admission requirements", 6), ("faq", 4), ("english", 3), ("language", 2), ("ielts", 3), ("toefl", 3), ("pte", 2), ("duolingo", 2), ("proficiency", 2), ("instruction", 1)],
    "academic_requirement": [("minimum admission requirements", 8), ("admissions requirements", 7), ("admission requirements", 7), ("graduate school requirements", 6), ("admissions", 5), ("academic", 2), ("admission", 2), ("entry", 2), ("requirement", 2), ("requirements", 2), ("eligibility", 2), ("qualification", 1)],
    "prerequisite_keywords": [("minimum admission requirements", 8), ("admissions requirements", 7), ("admission requirements", 7), ("admissions", 5), ("admission", 1), ("requirement", 2), ("requirements", 2), ("prerequisite", 3), ("background", 2), ("curriculum", 1)],
}

# ---- fixed values: eligible values ----
YEAR = r"\b20\d{2}\b"
PROGRAM_WORD = r"(?i)\b(master|doctor|bachelor|msc|phd|ma|mba|mphil)\b"
DEADLINE_VALUE_REJECTED = [r"\bplease visit\b", r"\bread article\b", r"\bfor details?\b", r"\bapplication method\b"]
DEADLINE_VALUE_ACCEPTED = [r"\b20\d{2}\b", r"\b\d{1,2}/\d{1,2}/\d{2,4}\b", r"\b\d{4}-\d{2}-\d{2}\b", r"\brolling\b", r"\bround\s*\d\b"]
TUITION_VALUE_REJECTED = [r"\bapplication fees?\b", r"\bcaution money\b", r"\bstudent activity fee\b", r"\bgraduation\b", r"\bre-?examination\b", r"\brepeating\b", r"\btuition fee reduction\b", r"\bfee reduction\b", r"\bcredit transfer\b", r"\bexemption\b", r"\bmicromasters?\b", r"\bwaiv(?:er|ed|ing)?\b", r"\bscholarship\b", r"\bfellowship\b", r"\bftss\b", r"\bfinancial aid\b", r"\bsubsid(?:y|ies|ized|ised)\b"]

# ---- fixed values: evaluation ----
SCALAR_FIELDS = ["program_name", "deadline", "tuition", "english_requirement", "academic_requirement"]
AGGREGATED_FIELDS = ["program_name", "department", "duration", "deadline", "tuition", "english_requirement", "academic_requirement"]
EVALUATED_FIELDS = [*SCALAR_FIELDS, "prerequisite_keywords"]
READY_STATUSES = ["manually_curated", "manually_curated_example", "benchmark_ready", "completed", "ready"]
