"""Vocabularies, rank maps and small dimensions that results depend on."""

# Work-item and record vocabularies.
TASK_STATUSES = ["Backlog", "Ready", "In Progress", "Review", "Done"]
PRIORITIES = ["Low", "Medium", "High", "Critical"]
RELEVANCES = ["Low", "Medium", "High", "Critical"]
CATEGORIES = [
    "Requirement", "Bug", "Design", "Test", "Result", "Reference", "User Feedback", "Decision", "Other",
]
RELATION_TYPES = [
    "supports", "contradicts", "relates_to", "depends_on", "causes", "derives_from", "supersedes",
    "similar_to", "cites", "mentioned_by", "part_of",
]
STRENGTHS = ["weak", "moderate", "strong", "critical"]

# Rank of a priority on the board, and of a relevance as a number.
PRIORITY_RANK = {"Low": 0, "Medium": 1, "High": 2, "Critical": 3}
RELEVANCE_NUMBER = {"Low": 1, "Medium": 2, "High": 3, "Critical": 4}

# Three-level category hierarchy.
CATEGORY_TREE = {
    "Requirement": {
        "Functional": ["Core", "UI", "API", "Integration", "Security"],
        "Non-functional": ["Performance", "Scalability", "Usability", "Security", "Compliance"],
        "Business": ["Stakeholder", "Market", "Regulatory", "Financial"],
    },
    "Bug": {
        "Severity": ["Critical", "High", "Medium", "Low", "Trivial"],
        "Type": ["Functional", "UI", "Performance", "Security", "Data", "Logic"],
    },
    "Design": {
        "Architecture": ["System", "Component", "Interface", "Database"],
        "UI/UX": ["Wireframe", "Mockup", "Prototype", "User Flow", "Style Guide"],
        "Technical": ["Algorithm", "Data Structure", "Pattern", "Infrastructure"],
    },
    "Test": {
        "Unit": ["Function", "Class", "Module"],
        "Integration": ["Component", "API", "System", "End-to-End"],
        "Performance": ["Load", "Stress", "Scalability", "Endurance"],
        "Security": ["Penetration", "Vulnerability", "Compliance"],
    },
    "Result": {
        "Test": ["Passed", "Failed", "Blocked", "Skipped"],
        "Benchmark": ["Performance", "Memory", "CPU", "Network", "Storage"],
        "User": ["Feedback", "Survey", "Interview", "Usage Analytics"],
    },
    "Reference": {
        "Document": ["Specification", "Manual", "Guide", "Standard"],
        "Code": ["Example", "Library", "Framework", "Pattern"],
        "External": ["Research Paper", "Article", "Book", "Standard"],
    },
    "User Feedback": {
        "Source": ["Interview", "Survey", "Support", "Review", "Usage Data"],
        "Sentiment": ["Positive", "Neutral", "Negative", "Mixed"],
    },
    "Decision": {
        "Scope": ["Project", "Feature", "Technical", "Business"],
        "Status": ["Proposed", "Approved", "Rejected", "Deferred", "Implemented"],
    },
    "Other": {
        "General": ["Note", "Idea", "Question", "Observation"],
    },
}

# Tags suggested for a primary category.
SUGGESTED_TAGS = {
    "Requirement": ["priority", "scope", "stakeholder", "epic"],
    "Bug": ["regression", "blocker", "ui", "backend", "reproducible"],
    "Design": ["approved", "draft", "final", "reviewed"],
    "Test": ["automated", "manual", "regression", "smoke"],
    "Result": ["baseline", "regression", "improvement", "degradation"],
    "Reference": ["standard", "best-practice", "example", "documentation"],
    "User Feedback": ["feature-request", "bug-report", "praise", "complaint"],
    "Decision": ["approved", "rejected", "pending", "final"],
    "Other": ["followup", "question", "idea"],
}

# MIME type by file extension.
MIME_TYPES = {
    ".txt": "text/plain",
    ".pdf": "application/pdf",
    ".doc": "application/msword",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".png": "image/png",
    ".py": "text/x-python",
    ".js": "text/javascript",
    ".json": "application/json",
    ".html": "text/html",
    ".csv": "text/csv",
    ".md": "text/markdown",
}
DEFAULT_MIME = "application/octet-stream"

# Storage quotas (bytes, files) of a project and of a user.
QUOTAS = {"project": (1073741824, 1000), "user": (536870912, 500)}

# Delivery retry settings, milliseconds.
RETRY = {"max_retries": 5, "base": 5000, "factor": 2, "cap": 120000}

# Lexicon of the built-in scorer: words of our own choice for finance headlines.
POSITIVE_WORDS = ["gain", "gains", "growth", "profit", "record", "beat", "beats", "strong"]
NEGATIVE_WORDS = ["loss", "losses", "drop", "fall", "falls", "weak", "miss", "risk"]
