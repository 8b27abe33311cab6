"""Reports as data: nested JSON, SARIF, markdown and accepted-debt baselines."""
