"""Fixed values of the finding model: enumerations in order of rank, weights, permissions of status."""

# From lowest to highest rank.
SEVERITIES = ["INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL"]
CONFIDENCES = ["LOW", "MEDIUM", "HIGH", "CONFIRMED"]
EXPLOITABILITIES = ["THEORETICAL", "POSSIBLE", "LIKELY", "PROVEN_DATAFLOW"]
ACTIVE = ["OPEN", "IN_PROGRESS", "REOPENED"]
# Default risk weights by factor.
WEIGHTS = {
    "severity": {"CRITICAL": 10.0, "HIGH": 7.0, "MEDIUM": 4.0, "LOW": 1.5, "INFO": 0.0},
    "confidence": {"CONFIRMED": 1.0, "HIGH": 0.9, "MEDIUM": 0.6, "LOW": 0.3},
    "exploitability": {"PROVEN_DATAFLOW": 1.0, "LIKELY": 0.85, "POSSIBLE": 0.65, "THEORETICAL": 0.45},
    "exposure": {"INTERNET_FACING": 1.25, "INTERNAL": 0.9, "UNKNOWN": 1.0},
    "business_criticality": {"CRITICAL": 1.3, "HIGH": 1.15, "MEDIUM": 1.0, "LOW": 0.85},
    "verification": {"CONFIRMED": 1.0, "DETECTED": 1.0, "AI_SUGGESTED": 0.5, "FALSE_POSITIVE": 0.0, "NOT_TESTED": 0.0},
    "status": {
        "OPEN": 1.0, "IN_PROGRESS": 1.0, "REOPENED": 1.0, "RESOLVED": 0.0, "FALSE_POSITIVE": 0.0, "ACCEPTED_RISK": 0.0,
    },
}
# What a factor counts when its value is unknown (others: 1).
UNKNOWN_WEIGHT = {"severity": 0.0, "confidence": 0.0, "exploitability": 0.65}
SATURATION = 25.0
# Report order of retest results.
RETEST_ORDER = ["REGRESSION", "NEW", "STILL_OPEN", "NOT_TESTED", "NOT_REPRODUCED", "RESOLVED"]
# Roles from lowest to highest, those that see all projects of their organization, and what each role may do
# besides what lower ones may.
ROLES = ["VIEWER", "DEVELOPER", "SECURITY_ANALYST", "ADMIN", "OWNER"]
ORG_WIDE_ROLES = ["SECURITY_ANALYST", "ADMIN", "OWNER"]
PERMISSIONS = {
    "VIEWER": ["project:read", "scan:read", "finding:read", "report:read", "aisec:read"],
    "DEVELOPER": [
        "scan:create", "finding:update_status", "ai_analysis:request", "remediation:create", "remediation:decide", "report:create",
    ],
    "SECURITY_ANALYST": [
        "project:create", "scan:cancel", "finding:triage", "aisec:run", "aisec:manage", "integration:read", "settings:read", "member:read",
    ],
    "ADMIN": [
        "project:update", "project:delete", "project:members:manage", "integration:manage", "settings:manage", "audit:read",
        "member:manage", "apikey:manage",
    ],
    "OWNER": [],
}
