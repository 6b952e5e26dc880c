"""Fixed values, written out once more so that code and SQL cannot drift together."""

from codequarry import catalog as C


def test_languages():
    assert len(C.LANGUAGES) == 35
    assert [C.LANGUAGES[e] for e in (".py", ".js", ".java", ".go", ".h")] == [
        "Python", "JavaScript", "Java", "Go", "C/C++ Header"]


def test_words_and_thresholds():
    assert C.DECISION_WORDS == ["if", "for", "while", "switch", "catch"]
    assert C.COMMENT_STARTS == ["#", "//", "/*", "*"]
    assert (C.MAX_ARGUMENTS, C.TOP_CONCEPTS, C.INDENT_WIDTH, C.QUERY_LINES) == (5, 10, 4, 10)
    assert (C.SIMILAR_ABOVE, C.SIMILAR_BELOW) == (0.7, 0.99)
    assert (C.MAX_UPLOAD_FILES, C.MAX_UPLOAD_FILE_BYTES, C.MAX_UPLOAD_TOTAL_BYTES) == (100, 5_242_880, 104_857_600)
    assert C.RETENTION_HOURS == 24


def test_rules():
    assert [r[0] for r in C.SMELL_RULES] == ["long_method", "complex_condition", "magic_number"]
    assert [r[0] for r in C.SECURITY_RULES] == [
        "sql_injection", "command_injection", "hardcoded_secret", "insecure_hash"]
    assert list(C.REVIEW_RECOMMENDATIONS) == [
        "documentation", "complexity", "components", "coupling", "naming", "testing", "security"]
    assert [n for n, _ in C.QUESTION_PATTERNS] == ["what", "how", "where", "why", "list", "explain", "compare"]
