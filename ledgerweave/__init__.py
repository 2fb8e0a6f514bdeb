"""Spark-native invoice / tax-credit reconciliation.

Two invoice books (a buyer's purchase register and the supplier-reported
GSTR-2B sheets) are cleaned, consolidated per (supplier GSTIN, invoice),
paired, classified and summarised entirely as DataFrame jobs.
"""

__all__ = ["session"]
