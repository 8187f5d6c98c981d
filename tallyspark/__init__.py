"""Transaction-ledger analytics expressed as Spark DataFrame plans.

Every public function takes DataFrames and returns DataFrames; none of them creates a session.
"""
