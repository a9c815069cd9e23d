"""Fixed values of the flow and alert model."""

from __future__ import annotations

# Severity of each tactic, and of an unknown one.
SEVERITY = {
    "Benign": 0.0, "Recon": 0.35, "Reconnaissance": 0.35, "Discovery": 0.38, "InitialAccess": 0.60, "CredentialAccess": 0.65, "Execution": 0.72, "Persistence": 0.75,
    "DefenseEvasion": 0.75, "PrivilegeEscalation": 0.78, "C2": 0.82, "CommandAndControl": 0.82, "LateralMovement": 0.85, "Exfiltration": 0.92, "Impact": 0.96,
}
UNKNOWN_SEVERITY = 0.50
# The order of stages in an attack.
STAGES = ("Recon", "CredentialAccess", "InitialAccess", "Execution", "C2", "LateralMovement", "Exfiltration", "Impact")
# Earliest and latest plausible epoch seconds (2010 and 2030), and ports of web and shell traffic.
EARLIEST, LATEST = 1262304000, 1893456000
WEB_PORTS, SHELL_PORTS, QUIET_PORTS = (80, 443, 8000, 8080, 8443), (22, 23), (53, 22, 23)
EDGE_THRESHOLD = 0.35
