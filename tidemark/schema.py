"""Declared schemas. Nothing is inferred: inference would turn identifiers with leading zeros into numbers."""

from __future__ import annotations


BARS = (
    "security_id string, ts timestamp, open double, high double, low double, close double, volume double, "
    "adjusted_close double, adjusted_high double, adjusted_low double, available_time timestamp, ingestion_time timestamp, "
    "data_version string, source string"
)
ACTIONS = "record_id string, security_id string, action_type string, event_time timestamp, effective_time timestamp, available_time timestamp, ingestion_time timestamp, ratio_text string, amount double"
RAW_PAYLOADS = "security_id string, source string, ingestion_time timestamp, batch_id string, payload string"
SHORT_INTEREST_CSV = "security_id string, settlement_date date, quantity double, avg_volume double, days_to_cover double"
HOLDINGS_CSV = "security_id string, quarter_end date, shares double, num_institutions int"
FILER_HOLDINGS_CSV = "security_id string, filer_cik string, quarter_end date, shares double"
SUBMISSIONS_TSV = "ACCESSION_NUMBER string, CIK string, PERIODOFREPORT string, FILING_DATE string, SUBMISSIONTYPE string"
INTERVALS_CSV = "ticker string, start_date string, end_date string"
RENAMES_CSV = "old_ticker string, new_ticker string"
EOD_CSV = "date string, open double, high double, low double, close double, volume double, adj_close double"
INFO_TABLE_XML = "nameOfIssuer string, cusip string, shrsOrPrnAmt struct<sshPrnamt:string,sshPrnamtType:string>, putCall string"
FORM4_XML = (
    "reportingOwner struct<reportingOwnerId:struct<rptOwnerCik:string>,reportingOwnerRelationship:struct<isDirector:string,isOfficer:string,isTenPercentOwner:string>>, "
    "aff10b5One string, nonDerivativeTable struct<nonDerivativeTransaction:array<struct<transactionDate:struct<value:string>,"
    "transactionCoding:struct<transactionCode:string>,transactionAmounts:struct<transactionShares:struct<value:string>,"
    "transactionPricePerShare:struct<value:string>,transactionAcquiredDisposedCode:struct<value:string>>>>>"
)
