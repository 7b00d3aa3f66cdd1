"""revisit: repeat-buyer features and model on Spark.

Main entry points
-----------------
sources.fixtures.load_tables / sources.raw.load_raw   input tables
operators.reduce.reduce_transactions                  offer-related lines
operators.lookback.purchase_facts / lookback_features window and user features
operators.market.product_share / competition          market features
operators.assemble.assemble_features                  34-feature table
operators.model                                       search, fit, score, AUC
plans.run_all.run_pipeline                            everything, stage by stage
plans.queries.queries                                 one query per operator
streaming.reduce_stream.run_reduction                 streaming reduction
"""
