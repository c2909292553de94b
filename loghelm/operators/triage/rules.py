"""Rule tables: (category, priority, condition, text), in order.

A condition is a SQL predicate over the context columns of ``context.py``.
``{n}`` and ``{reason}`` in a text stand for the row's event count and
escalation reason.
"""

AUTH_OR_SSH = "(x_auth OR contains(x_msg, 'brute force') OR contains(x_service, 'ssh'))"
RECON_OR_SWEEP = "(x_recon OR contains(x_msg, 'port sweep'))"
PRIV_OR_ROOT = "(x_priv OR contains(x_msg, 'root access'))"
ERRORS = "(contains(x_msg, 'error') OR contains(x_msg, 'exception') OR contains(x_msg, 'crash'))"

# Detection factors.
FACTORS = [
    ("critical_confidence", 100, "x_prob >= 0.90",
     "Extremely high anomaly probability detected"),
    ("confidence", 90, "x_prob >= 0.75 AND x_prob < 0.90",
     "High anomaly confidence score"),
    ("authentication_behavior", 88, AUTH_OR_SSH,
     "Authentication-related activity deviates from expected behavioral patterns"),
    ("credential_access", 92, AUTH_OR_SSH,
     "Observed indicators align with potential credential-access or brute-force activity"),
    ("authentication_risk", 97, f"{AUTH_OR_SSH} AND x_prob >= 0.8",
     "High-confidence authentication anomaly suggests elevated compromise risk"),
    ("behavioral_correlation", 99, f"{AUTH_OR_SSH} AND x_corr",
     "Repeated authentication anomalies triggered behavioral correlation escalation"),
    ("mitre_reconnaissance", 93, RECON_OR_SWEEP,
     "Observed behavior aligns with MITRE ATT&CK Active Scanning reconnaissance patterns"),
    ("recon_behavior", 88, RECON_OR_SWEEP,
     "Network probing activity suggests hostile reconnaissance or attack surface enumeration"),
    ("mitre_privilege_escalation", 95, PRIV_OR_ROOT,
     "Behavior aligns with privilege escalation activity associated with ATT&CK T1548 techniques"),
    ("privilege_behavior", 84, PRIV_OR_ROOT,
     "Elevated privilege activity deviates from expected operational patterns"),
    ("mitre_execution", 90, "x_exec",
     "Command execution behavior aligns with ATT&CK scripting interpreter techniques"),
    ("execution_behavior", 82, "x_exec",
     "Observed execution patterns may indicate unauthorized scripted activity"),
    ("behavioral_detection", 98, "x_corr",
     "Behavioral correlation engine identified repeated suspicious activity within the configured observation window"),
    ("multi_event_activity", 96, "x_corr AND x_n >= 3",
     "Multiple correlated suspicious events detected ({n} related events observed)"),
    ("critical_attack_progression", 100, "x_corr AND x_n >= 5",
     "Sustained hostile behavioral patterns indicate elevated likelihood of active compromise progression"),
    ("escalation_reasoning", 94, "x_corr AND x_reason <> ''",
     "Escalation rationale: {reason}"),
    ("authentication", 85, "contains(x_msg, 'failed') OR contains(x_msg, 'login') OR contains(x_msg, 'password')",
     "Suspicious authentication activity detected"),
    ("service_behavior", 70, ERRORS,
     "Abnormal service behavior observed"),
    ("reconnaissance", 80, "contains(x_msg, 'arp') OR contains(x_msg, 'scan') OR contains(x_msg, 'flood')",
     "Potential network reconnaissance activity"),
    ("severity_narrative", 40, "x_sev = 'LOW'",
     "Observed anomaly currently reflects low-confidence deviation from established behavioral baseline"),
    ("severity_narrative", 65, "x_sev = 'MEDIUM'",
     "Anomalous behavior demonstrates moderate deviation requiring additional contextual validation"),
    ("severity_narrative", 90, "x_sev = 'HIGH'",
     "Elevated anomaly severity indicates increased likelihood of malicious or unauthorized operational activity"),
    ("severity_narrative", 100, "x_sev = 'CRITICAL'",
     "Critical threat conditions suggest sustained hostile activity requiring immediate incident-response escalation"),
    ("attack_progression", 97, "x_corr AND x_sev = 'HIGH'",
     "Correlated high-severity activity suggests coordinated attack progression rather than isolated anomalous behavior"),
    ("critical_attack_lifecycle", 100, "x_corr AND x_crit",
     "Sustained correlated threat activity indicates possible active compromise lifecycle progression within the monitored environment"),
    ("privileged_targeting", 96, "contains(x_msg, 'failed password') AND contains(x_msg, 'root')",
     "Privileged account targeting behavior suggests elevated adversarial intent against critical authentication assets"),
    ("privilege_abuse", 94, "contains(x_msg, 'sudo') AND x_sev = 'HIGH'",
     "Elevated privilege operations combined with anomalous execution patterns may indicate attempted privilege abuse"),
    ("recon_attack_staging", 91, "contains(x_msg, 'scan') AND x_sev <> 'LOW'",
     "Reconnaissance behavior observed prior to elevated anomaly escalation may indicate attack staging activity"),
    ("privileged_asset_risk", 95, "contains(x_msg, 'root') OR contains(x_msg, 'administrator')",
     "Activity targeting privileged authentication assets increases potential operational impact severity"),
    ("remote_access_threat", 97, "contains(x_msg, 'ssh') AND x_corr",
     "Repeated remote authentication anomalies may indicate active external access attempts against exposed services"),
    ("persistence_risk", 90, "x_pers",
     "Unexpected scheduled-task behavior may indicate persistence establishment attempts"),
    ("operational_privilege_risk", 94, "contains(x_msg, 'sudo') OR contains(x_msg, 'privilege escalation')",
     "Privilege-related anomalous behavior may enable expanded attacker control across affected systems"),
    ("pre_attack_recon", 88, "contains(x_msg, 'scan') OR contains(x_msg, 'nmap')",
     "Reconnaissance activity may represent pre-exploitation mapping of accessible network resources"),
    ("incident_response_context", 100, "x_crit",
     "Critical threat severity combined with correlated behavioral indicators warrants immediate containment assessment"),
    ("temporal_activity", 92, "x_n >= 2",
     "Repeated suspicious activity observed across {n} correlated events within the active monitoring window"),
    ("temporal_escalation", 96, "x_n >= 4",
     "Escalating anomaly frequency suggests sustained adversarial interaction with monitored services"),
    ("persistent_attack_activity", 100, "x_n >= 6",
     "Extended sequence of correlated hostile events indicates persistent attack lifecycle progression"),
    ("high_confidence_persistence", 97, "x_n >= 3 AND x_hs",
     "High-severity anomalies persisting across multiple behavioral observations increase confidence in malicious intent"),
    ("critical_persistence", 100, "x_n >= 5 AND x_crit",
     "Critical anomaly persistence suggests active compromise conditions requiring immediate containment validation"),
    ("confidence_calibration", 100, "x_prob >= 0.95",
     "Anomaly confidence exceeds critical detection threshold, significantly increasing likelihood of genuine malicious activity"),
    ("confidence_calibration", 92, "x_prob >= 0.85 AND x_prob < 0.95",
     "Elevated anomaly confidence indicates strong deviation from established behavioral baselines"),
    ("confidence_calibration", 72, "x_prob >= 0.70 AND x_prob < 0.85",
     "Observed activity demonstrates moderate statistical deviation requiring contextual investigation"),
    ("confidence_calibration", 55, "x_prob >= 0.50 AND x_prob < 0.70",
     "Low-confidence anomaly indicators suggest possible early-stage or weakly correlated abnormal behavior"),
    ("investigation_priority", 94, "x_hs",
     "Observed threat characteristics warrant prioritized analyst investigation due to elevated operational risk"),
    ("forensic_guidance", 95, "x_corr",
     "Correlated behavioral indicators increase importance of timeline-based forensic review"),
    ("authentication_review", 90, "contains(x_msg, 'failed password') OR contains(x_msg, 'invalid user')",
     "Authentication anomaly patterns warrant focused review of remote access telemetry and account activity"),
    ("privilege_review", 92, "contains(x_msg, 'sudo') OR contains(x_msg, 'root')",
     "Privilege-related anomaly indicators justify validation of authorization boundaries and elevated session activity"),
    ("network_review", 88, "contains(x_msg, 'scan') OR contains(x_msg, 'nmap')",
     "Reconnaissance indicators suggest value in reviewing adjacent network telemetry for lateral probing activity"),
    ("fusion_auth_privilege", 99, "x_auth AND x_priv",
     "Authentication anomalies combined with privilege-related activity may indicate attempted post-compromise escalation behavior"),
    ("fusion_recon_persistence", 97, "x_recon AND x_pers",
     "Reconnaissance behavior combined with persistence-oriented activity suggests structured attack lifecycle progression"),
    ("fusion_critical_correlation", 100, "x_corr AND x_crit",
     "Critical correlated threat indicators strongly suggest coordinated hostile activity rather than isolated anomalous events"),
    ("fusion_execution_privilege", 98,
     "(contains(x_msg, 'bash') OR contains(x_msg, 'powershell') OR contains(x_msg, 'cmd')) AND x_priv",
     "Privileged execution activity combined with anomalous scripting behavior may indicate active attacker operations"),
    ("intent_credential_access", 96, "x_auth AND x_hs",
     "Behavioral indicators suggest probable credential-access objectives targeting authentication infrastructure"),
    ("intent_privilege_control", 98, "x_priv AND x_corr",
     "Correlated privilege-related anomalies may indicate attempted expansion of attacker control within the environment"),
    ("intent_reconnaissance", 94, "x_recon AND x_n >= 3",
     "Sustained reconnaissance-oriented behavior suggests active environmental discovery or attack surface mapping objectives"),
    ("intent_persistence", 95, "x_pers AND x_sev <> 'LOW'",
     "Persistence-oriented anomalous behavior may indicate attempts to maintain long-term unauthorized system access"),
    ("intent_operational_staging", 100, "x_auth AND x_priv AND x_corr",
     "Combined authentication, privilege, and behavioral escalation indicators suggest coordinated adversarial operational staging activity"),
    ("evidentiary_low_confidence", 45, "x_sev = 'LOW' AND x_prob < 0.60",
     "Current anomaly indicators remain weakly correlated and should be interpreted as preliminary behavioral deviations pending additional telemetry"),
    ("evidentiary_moderate_confidence", 70, "x_sev = 'MEDIUM'",
     "Observed anomaly characteristics demonstrate sufficient behavioral deviation to justify contextual investigation, though direct malicious intent remains unconfirmed"),
    ("evidentiary_high_confidence", 96, "x_sev = 'HIGH' AND x_prob >= 0.85",
     "Multiple converging anomaly indicators substantially increase confidence that the observed behavior reflects genuine hostile or unauthorized operational activity"),
    ("evidentiary_critical_compromise", 100, "x_crit AND x_corr",
     "Correlated critical-severity telemetry provides strong evidentiary support for active compromise assessment and immediate containment validation"),
    ("lifecycle_recon_to_access", 97, "x_recon AND x_auth",
     "Reconnaissance-oriented activity followed by authentication anomalies may indicate transition from discovery into active access attempts"),
    ("lifecycle_access_to_privilege", 98, "x_auth AND x_priv",
     "Authentication-related anomalies combined with privilege-focused activity suggest potential post-access escalation progression"),
    ("lifecycle_privilege_to_persistence", 99, "x_priv AND x_pers",
     "Privilege-oriented activity followed by persistence-related behavior may indicate attempts to establish durable unauthorized access"),
    ("lifecycle_multi_stage_attack", 100, "x_corr AND x_n >= 5",
     "Sustained correlated anomalies across multiple behavioral domains suggest progression through multiple attack lifecycle stages"),
    ("lifecycle_active_compromise", 100, "x_crit AND (x_auth OR x_priv) AND x_corr",
     "Critical correlated access and privilege indicators may reflect active compromise progression requiring immediate containment assessment"),
    ("contextual_attack_escalation", 100, "x_auth AND x_priv AND x_corr",
     "Centralized threat analysis identified converging authentication, privilege, and correlation indicators consistent with escalating adversarial activity"),
    ("contextual_recon_to_access", 98, "x_recon AND x_auth",
     "Threat-context correlation suggests reconnaissance behavior transitioned into active authentication targeting activity"),
    ("contextual_persistence_control", 99, "x_pers AND x_priv",
     "Persistence-oriented activity combined with elevated privilege indicators may reflect attempts to maintain durable unauthorized control"),
]
# The factor of a row on which no rule fires.
FACTOR_FALLBACK = [("baseline_deviation", 60, "Behavior deviated from learned normal baseline")]

# Categories always shown, and topics of which one factor is enough.
CRITICAL_CATEGORIES = [
    "critical_attack_progression",
    "critical_attack_lifecycle",
    "behavioral_detection",
    "attack_progression",
    "credential_access",
    "privileged_targeting",
]
TOPICS = {
    "authentication": ["authentication", "credential", "remote_access"],
    "escalation": ["privilege", "critical_attack", "attack_progression"],
    "reconnaissance": ["recon", "network_review", "pre_attack"],
    "persistence": ["persistence", "scheduled", "temporal"],
}
SHOWN_FACTORS = 6
CLASS_CUTS = [(100, "critical"), (95, "high"), (85, "medium")]

# ATT&CK mapping as (words, tactic, technique, technique id).
ATTACK = [
    (["failed password", "authentication failed", "brute force"], "Credential Access", "Brute Force", "T1110"),
    (["scan", "recon", "arp"], "Reconnaissance", "Active Scanning", "T1595"),
    (["sudo", "root", "privilege"], "Privilege Escalation", "Abuse Elevation Control Mechanism", "T1548"),
    (["process", "execution", "binary"], "Execution", "Command and Scripting Interpreter", "T1059"),
]


def _any(column: str, *words: str) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


# Recommendations.
RECOMMENDATIONS = [
    ("general", 50, "x_status = 'CLOSED'",
     "Incident already resolved by analyst workflow"),
    ("general", 50, "x_status = 'CLOSED'",
     "Maintain monitoring for anomaly recurrence"),
    ("severity_escalation", 95, "x_hs",
     "Prioritize investigation due to elevated threat severity and validate whether the activity indicates active compromise behavior"),
    ("correlation", 90, "x_hs",
     "Correlate related anomalies, affected hosts, and recent behavioral activity to determine potential attack scope"),
    ("incident_response", 100, "x_crit",
     "Immediate incident response escalation recommended due to sustained or highly correlated malicious activity"),
    ("compromise_analysis", 98, "x_crit",
     "Investigate potential active compromise, lateral movement, or coordinated attack behavior across affected systems"),
    ("containment", 96, "x_crit",
     "Consider containment actions, endpoint isolation, and rapid forensic validation to limit potential impact"),
    ("authentication", 92, "x_auth",
     "Investigate repeated authentication failures and correlate source IP activity for potential brute-force behavior"),
    ("credential_compromise", 88, "x_auth",
     "Review impacted accounts and validate whether credential compromise indicators are present"),
    ("session_analysis", 84, "x_auth",
     "Validate authentication logs, session anomalies, and privilege escalation attempts associated with the affected system"),
    ("database_access", 90, _any("x_service", "db", "mysql", "postgres"),
     "Investigate abnormal database access patterns and review privileged query activity for potential misuse or unauthorized access"),
    ("database_integrity", 82, _any("x_service", "db", "mysql", "postgres"),
     "Validate database service integrity, uptime stability, and recent configuration or permission changes"),
    ("web_threat_analysis", 88, _any("x_service", "http", "apache", "nginx"),
     "Investigate abnormal web application behavior and review HTTP/server logs for suspicious request patterns or attack indicators"),
    ("deployment_validation", 80, _any("x_service", "http", "apache", "nginx"),
     "Validate recent deployments, configuration changes, and traffic anomalies that may have contributed to service instability"),
    ("general", 50, _any("x_service", "hdfs"),
     "Monitor distributed node synchronization behavior"),
    ("general", 50, _any("x_service", "hdfs"),
     "Validate cluster communication consistency"),
    ("general", 50, _any("x_service", "hdfs"),
     "Observe anomaly recurrence across nodes"),
    ("persistence", 87, "x_pers",
     "Investigate unusual scheduled task behavior and review recent cron activity for unauthorized persistence or execution patterns"),
    ("scheduled_task_validation", 82, "x_pers",
     "Validate recently modified scheduled jobs, execution frequency anomalies, and privilege context associated with recurring tasks"),
    ("mail_abuse", 88, _any("x_service", "sendmail", "smtp", "mail"),
     "Review outbound mail activity and inspect for abnormal relay behavior, phishing distribution patterns, or spam-related anomalies"),
    ("mail_configuration", 80, _any("x_service", "sendmail", "smtp", "mail"),
     "Validate mail service configuration integrity and investigate unusual message delivery spikes or authentication failures"),
    ("privilege_escalation", 95, "x_priv",
     "Investigate potential privilege escalation behavior and review elevated command execution activity across affected systems"),
    ("privileged_access_review", 90, "x_priv",
     "Validate administrative access patterns, account authorization scope, and suspicious privileged operations"),
    ("execution_analysis", 92, _any("x_msg", "execution", "process", "binary", "spawn"),
     "Review suspicious process execution behavior and investigate unexpected binary launches or abnormal parent-child process relationships"),
    ("execution_correlation", 88, _any("x_msg", "execution", "process", "binary", "spawn"),
     "Correlate execution activity with recent authentication events, privilege escalation attempts, or persistence indicators"),
    ("file_integrity", 90, _any("x_msg", "file", "integrity", "modified", "deleted"),
     "Investigate unexpected file modification activity and validate integrity changes across monitored assets or sensitive directories"),
    ("tampering_analysis", 86, _any("x_msg", "file", "integrity", "modified", "deleted"),
     "Review recent user actions, permission changes, and potential tampering indicators associated with affected files"),
    ("resource_abuse", 88, _any("x_msg", "memory", "cpu", "resource", "exhaustion"),
     "Review abnormal resource utilization patterns and investigate potential exhaustion attacks, runaway processes, or malicious workload activity"),
    ("system_stability", 82, _any("x_msg", "memory", "cpu", "resource", "exhaustion"),
     "Validate system stability metrics, process consumption behavior, and infrastructure performance degradation indicators"),
    ("network_connections", 91, _any("x_msg", "connection", "traffic", "port"),
     "Investigate suspicious network connection behavior and correlate unusual communication patterns across hosts, ports, and external endpoints"),
    ("traffic_analysis", 86, _any("x_msg", "connection", "traffic", "port"),
     "Review connection frequency anomalies, failed communication attempts, and unexpected outbound traffic behavior"),
    ("behavioral_correlation", 97, "x_corr",
     "Investigate repeated behavioral activity associated with this anomaly and correlate related events across the active monitoring window"),
    ("attack_progression", 95, "x_corr",
     "Review attack progression indicators, recurring source activity, and multi-event escalation behavior for signs of sustained compromise attempts"),
    ("critical_incident", 100, "x_threat >= 100",
     "Treat this activity as a potentially active security incident requiring immediate containment and accelerated investigation workflow"),
    ("forensic_escalation", 98, "x_threat >= 100",
     "Prioritize forensic validation, attack-scope assessment, and rapid analyst escalation due to critical threat scoring"),
    ("threat_prioritization", 92, "x_threat >= 75 AND x_threat < 100",
     "Prioritize this anomaly for investigation due to elevated threat scoring and increased likelihood of malicious activity"),
    ("reconnaissance", 94, "x_recon",
     "Investigate potential reconnaissance or scanning behavior and correlate network activity across related hosts and source IP addresses"),
    ("lateral_movement", 90, "x_recon",
     "Review lateral movement indicators, unusual traffic patterns, and endpoint communication anomalies for possible attack propagation"),
    ("containment", 96, "x_recon",
     "Consider containment or network isolation if sustained suspicious activity is confirmed"),
    ("service_instability", 86, ERRORS,
     "Investigate abnormal service behavior and review application logs for crashes, execution failures, or instability indicators"),
    ("configuration_validation", 78, ERRORS,
     "Validate recent deployments, configuration modifications, and dependency changes that may have triggered service disruption"),
    ("resource_analysis", 84, ERRORS,
     "Review system resource utilization and failure patterns for potential exhaustion, cascading failures, or malicious impact"),
    ("high_confidence", 89, "x_prob >= 0.90",
     "Treat anomaly activity as potentially high-risk until investigation and validation are completed"),
    ("contextual_review", 76, "x_hs OR x_prob >= 0.80",
     "Review related system activity, authentication behavior, and recent operational events surrounding the anomaly timeframe"),
    ("telemetry_correlation", 82, "x_hs OR x_prob >= 0.80",
     "Correlate anomaly indicators with additional telemetry sources to determine whether the activity reflects isolated failure or broader malicious behavior"),
]
# The recommendations of a row on which no rule fires.
RECOMMENDATION_FALLBACK = [
    ("monitoring", 30,
     "Continue monitoring anomaly behavior and validate whether additional related indicators emerge over time"),
    ("general_correlation", 45,
     "Correlate this anomaly with additional telemetry sources and surrounding operational activity for further investigation context"),
]
SHOWN_RECOMMENDATIONS = 5

# Analyst decisions and their reasons, first match wins.
DECISIONS = [
    ("x_status = 'ACKNOWLEDGED'", "ESCALATE OR CLOSE",
     "Analyst already acknowledged this anomaly. Further investigation required."),
    ("x_sev = 'HIGH' AND x_prob >= 0.80", "ACKNOWLEDGE & INVESTIGATE",
     "High severity anomaly with strong ML confidence."),
    ("x_sev = 'MEDIUM' OR x_prob >= 0.60", "REVIEW",
     "Requires analyst verification before escalation."),
    ("TRUE", "FALSE POSITIVE REVIEW",
     "Low confidence anomaly. Verify before taking action."),
]
NO_DECISION = ("NO ACTIVE ANOMALIES", "No anomaly currently requires analyst action.")
