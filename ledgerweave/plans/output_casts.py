"""Output columns whose type is normalised at the query boundary (generated by
tools/gen_output_casts.py; tests check it against the Spark schemas)."""

OUTPUT_CASTS = {'cdnr_comments': {'date': [], 'double': ['taxable', 'cgst', 'sgst', 'igst']},
 'classify_notes': {'date': [], 'double': ['cgst', 'igst']},
 'coerce_numeric_columns': {'date': [], 'double': ['taxable_value', 'cgst', 'sgst', 'igst']},
 'comments_projection': {'date': [], 'double': ['taxable_value', 'cgst', 'sgst', 'igst']},
 'consolidate_by_key': {'date': ['inv_date'],
                        'double': ['taxable', 'cgst', 'sgst', 'igst', 'total_tax', 'invoice_value', 'cess']},
 'dashboard': {'date': [],
               'double': ['pr_cgst',
                          'pr_sgst',
                          'pr_igst',
                          'pr_total',
                          'b2_cgst',
                          'b2_sgst',
                          'b2_igst',
                          'b2_total']},
 'dashboard_pivot': {'date': [],
                     'double': ['matched_pr',
                                'matched_2b',
                                'almost_pr',
                                'almost_2b',
                                'not_matched_pr',
                                'not_matched_2b',
                                'total_pr',
                                'total_2b']},
 'fill_within_key': {'date': ['b2_date', 'pr_date'], 'double': []},
 'filter_itc_no': {'date': [], 'double': ['igst', 'cgst', 'sgst']},
 'filter_not_matched': {'date': [], 'double': ['igst', 'cgst', 'sgst']},
 'filter_rcm': {'date': [], 'double': ['igst', 'cgst', 'sgst']},
 'fuzzy_orphan_rescue': {'date': [], 'double': ['pr_cgst', 'b2_cgst']},
 'itc_filtered_sum': {'date': [], 'double': ['igst', 'cgst', 'sgst']},
 'itc_table': {'date': [], 'double': ['integrated', 'central', 'state', 'cess']},
 'not_matched_report': {'date': [],
                        'double': ['pr_cgst', 'b2_cgst', 'pr_sgst', 'b2_sgst', 'pr_igst', 'b2_igst']},
 'parse_amount': {'date': [], 'double': ['taxable', 'cgst', 'sgst', 'igst']},
 'parse_date': {'date': ['inv_date'], 'double': []},
 'pending_state': {'date': [], 'double': ['pr_cgst', 'b2_cgst']},
 'prior_period_itc': {'date': [], 'double': ['igst', 'cgst', 'sgst']},
 'recon_outer_join': {'date': ['pr_date', 'b2_date'], 'double': ['pr_cgst', 'b2_cgst', 'pr_igst', 'b2_igst']},
 'recon_projection': {'date': [],
                      'double': ['pr_cgst', 'b2_cgst', 'pr_sgst', 'b2_sgst', 'pr_igst', 'b2_igst']},
 'reconcile_given': {'date': [],
                     'double': ['pr_invoice_value',
                                'pr_cess',
                                'b2_total_tax',
                                'b2_invoice_value',
                                'b2_cess']},
 'reconcile_uploads': {'date': [], 'double': ['pr_cgst', 'b2_cgst', 'b2_cess']},
 'rescue_empty_inv_key': {'date': [], 'double': ['taxable']},
 'review_candidates': {'date': [],
                       'double': ['pr_cgst', 'b2_cgst', 'pr_sgst', 'b2_sgst', 'pr_igst', 'b2_igst']},
 'run_log': {'date': [], 'double': ['matched_value', 'mismatched_value']},
 'sign_credit_notes': {'date': [], 'double': ['taxable', 'cgst', 'sgst', 'igst']},
 'suffix_sides': {'date': ['inv_date'],
                  'double': ['taxable', 'cgst', 'sgst', 'igst', 'total_tax', 'invoice_value', 'cess']},
 'sum_column': {'date': [], 'double': ['sum_taxable', 'sum_cgst', 'sum_sgst', 'sum_igst']},
 'tax_period': {'date': ['filing_date', 'period_start'], 'double': []},
 'union_sheets': {'date': ['inv_date'], 'double': ['taxable', 'cgst', 'sgst', 'igst', 'total_tax']}}
